"""What an item means for a desk, as Columns: lines of business, themes, authority, room for action, nearness, freshness of markets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmill.functions import dates, lexicon, text

# Departments by words of a title and by free tags.
DEPARTMENTS = {
    "财富": "理财 基金 保险 黄金 贵金属 财富 资管 代销 信托 ETF 债市 国债 AUM 积存金 金条".split(),
    "信贷": "贷款 信贷 房贷 消费贷 经营贷 按揭 公积金 利率 首付 融资担保 普惠 小微".split(),
    "私行": "私行 家族 高净值 私人银行 股权 家办".split(),
    "客群": "客群 零售 代发 信用卡 养老 支付 商圈 储户 网点 反诈".split(),
}
TAG_DEPARTMENTS = {"代发": "客群", "信用卡": "客群", "养老": "客群", "市场": "客群", "政银合作": "客群", "消费贷": "信贷", "住房金融": "信贷", "跨境": "财富"}
# Local lines that a national item reaches, and the themes within each.
LINES = {
    "gz-wealth": "理财 基金 保险 黄金 财富 资产配置 私人银行 代销 AUM 信托".split(),
    "gz-credit": "信贷 贷款 房贷 消费贷 经营贷 按揭 公积金 利率 首付 融资担保".split(),
    "gz-customer": "社零 消费 零售 居民 收入 人口 就业 物价 CPI 民生 储蓄 存款 支付 商圈 市场运行".split(),
    "gz-private": "家族 股权 企业主 专精特新 半导体 集成电路 生物医药 高端制造 人工智能 芯片 知识产权 补贴 兑现 产业扶持 招商引资 独角兽".split(),
}
THEMES = {
    "gz-wealth": "理财 基金 保险 黄金 财富 资产配置 私人银行 代销 信托".split(),
    "gz-credit": "公积金 房贷 消费贷 经营贷 按揭 LPR 利率 首付 融资担保 信贷 贷款".split(),
    "gz-customer": "社零 消费 零售 居民收入 收入 人口 就业 物价 CPI 民生 储蓄 存款 支付 商圈 市场运行".split(),
    "gz-private": "家族 股权 企业主 专精特新 半导体 集成电路 生物医药 高端制造 人工智能 芯片 知识产权 产业扶持 招商引资 独角兽".split(),
}
# Authority of issuers and of sources.
TOP_ISSUERS = "央行 人民银行 国家金融监督管理总局 金融监管总局 金监总局 国务院 财政部 发改委 国资委 住建部 证监会 外汇局".split()
HIGH_ISSUERS = ["省[^\\s，。；、]{0,10}(?:厅|局)", "市[^\\s，。；、]{0,10}(?:局|办)", "省(?:政府|委)", "市(?:政府|委)", "银保监", "金融监管局"]
BODIES = "协会 总行 银行业".split()
FOREIGN_BANKS = ["(?:加拿大|韩国|日本|英国|欧洲|欧盟|澳洲|澳大利亚|新西兰|印度|俄罗斯|巴西|土耳其|瑞士|瑞典|挪威|墨西哥|印尼|泰国|越南|新加坡|马来西亚|沙特|南非)央行", "英格兰银行", "日本银行", "欧洲中央银行"]
SOURCES = {"govcn-policy": 0.95, "govcn": 0.95, "pbc": 0.95, "gz-sw": 0.88, "gd-gii": 0.86, "cnfin": 0.6, "stcn": 0.6, "21jingji-finance": 0.55, "sina-finance": 0.5, "sina-bank": 0.5, "guancha": 0.5, "eastmoney-a": 0.5, "eastmoney-hk": 0.5}
OTHER_SOURCE, COLUMN_FLOORS = 0.42, {"cn-policy": 0.9, "govcn-policy": 0.9, "cn-finance": 0.6}
# Kinds of action with their worth, in order, and nearness of places.
ACTIONS = [
    ("policy_action", 0.9, "新规 发文 意见 办法 通知 印发 出台 发布 延长 下调 上调 降息 降准 贴息 宽松 收紧 扩容 提额 试点 调整 落地 实施 监管".split()),
    ("risk_action", 0.85, "罚 处罚 违规 整改 通报 不良 逾期 违约 风险敞口".split()),
    ("data_context", 0.4, "数据 统计 同比 环比 回落 增长 下跌 大涨 大跌 震荡 分析 解读 回顾 展望 波动".split()),
    ("soft", 0.2, "获奖 榜单 排名 论坛 峰会 出口 签约 发布产品 活动正式启动 活动启动 启动仪式 开业 庆典 公益 赞助 冠名 招募 报名 年会 发布会 购物节 品牌日 财富季 营销 宣传周 直播 启幕 来袭 评选".split()),
]
OTHER_ACTION = ("default", 0.5)
NEAREST = "广州 穗 天河 海珠 琶洲 南沙 番禺 越秀 黄埔 花都 增城 从化 白云 广交会 广货行天下".split()
NEAR = "广东 大湾区 珠三角 香港 澳门 港澳 横琴".split()
# Names of markets in order, and wording of the note on those without news.
MARKETS = {"a_share": "A股", "hk": "港股", "us": "美股"}
ALL_STALE, SOME_STALE, STALE = "三地股市均无隔夜行情（休市或数据未更新），以下为最近一次收盘数据", "今日无隔夜行情，其余市场为最新收盘", "今日无隔夜行情"
ALL_STALE_SPOKEN = "三地股市今日均无隔夜行情"


@dataclass(frozen=True)
class Desk:
    """What the rules of a desk read: departments, free tags, lines and themes, authority of issuers and sources, kinds of action, and places."""

    departments: Mapping[str, Sequence[str]] = field(default_factory=lambda: DEPARTMENTS)
    tags: Mapping[str, str] = field(default_factory=lambda: TAG_DEPARTMENTS)
    lines: Mapping[str, Sequence[str]] = field(default_factory=lambda: LINES)
    themes: Mapping[str, Sequence[str]] = field(default_factory=lambda: THEMES)
    issuers: Sequence[tuple[Sequence[str], float]] = ((TOP_ISSUERS, 0.95), (HIGH_ISSUERS, 0.8), (BODIES, 0.6))
    foreign: Sequence[str] = tuple(FOREIGN_BANKS)
    sources: Mapping[str, float] = field(default_factory=lambda: SOURCES)
    other_source: float = OTHER_SOURCE
    floors: Mapping[str, float] = field(default_factory=lambda: COLUMN_FLOORS)
    actions: Sequence[tuple[str, float, Sequence[str]]] = tuple(ACTIONS)
    other_action: tuple[str, float] = OTHER_ACTION
    nearest: Sequence[str] = tuple(NEAREST)
    near: Sequence[str] = tuple(NEAR)


BANK = Desk()


def rolled_up(title: Column, tags: Column, v: Desk = BANK) -> Column:
    """Departments of the title, the free tags, and the departments of those, without repeats; null tags count as none."""
    free = F.coalesce(tags, F.array().cast("array<string>"))
    return F.array_distinct(F.concat(lexicon.all_matches(title, v.departments), text.mapped_tags(free, dict(v.tags))))


def lines_reached(title: Column, v: Desk = BANK) -> Column:
    """Local lines that a title reaches, in order."""
    return lexicon.all_matches(title, v.lines)


def theme_keys(title: Column, line: Column, v: Desk = BANK) -> Column:
    """Theme words of a line that stand in a title, or of all lines where line is null; none for unknown lines."""
    t = F.coalesce(title, F.lit(""))
    out = F.when(line.isNull(), F.array_distinct(lexicon.contained(t, [w for words in v.themes.values() for w in words]))).otherwise(F.array().cast("array<string>"))
    for name, words in v.themes.items():
        out = F.when(line == name, lexicon.contained(t, words)).otherwise(out)
    return out


def issuer_authority(said: Column, v: Desk = BANK) -> Column:
    """Authority of whoever issued what a text tells; central banks of other countries have none."""
    return lexicon.vetoed(lexicon.first_value(said, v.issuers), said, v.foreign)


def source_authority(source: Column, column: Column, v: Desk = BANK) -> Column:
    """Authority of a source, at least that of its column."""
    known = F.create_map(*(F.lit(x) for pair in v.sources.items() for x in pair))
    floor = F.lit(0.0)
    for name, value in v.floors.items():
        floor = F.when(column == name, value).otherwise(floor)
    return F.greatest(F.coalesce(F.try_element_at(known, source), F.lit(v.other_source)), floor)


def action(said: Column, v: Desk = BANK) -> Column:
    """Struct of type and score: the first kind of action whose words hit."""
    kind, score = F.lit(v.other_action[0]), F.lit(v.other_action[1])
    for name, value, words in reversed(v.actions):
        hit = lexicon.hits(said, words)
        kind, score = F.when(hit, name).otherwise(kind), F.when(hit, value).otherwise(score)
    return F.struct(kind.alias("type"), score.alias("score"))


def nearness(said: Column, locale: Column, v: Desk = BANK) -> Column:
    """1 for the city, 0.9 for the region or an item filed under the city, else 0."""
    return F.when(lexicon.hits(said, v.nearest), 1.0).when(lexicon.hits(said, v.near) | F.coalesce(locale == "gz", F.lit(False)), 0.9).otherwise(0.0)


def market_status(report: Column, days: Mapping[str, Column], most: int = 1) -> Column:
    """Struct of fresh (markets whose day lies 0 to `most` days back, in order), all_stale, note and spoken; a null day is stale."""
    fresh = {k: F.coalesce(dates.within_gap(days[k], report, most), F.lit(False)) for k in MARKETS}
    named = lambda keep: F.array_join(F.array_compact(F.array(*(F.when(keep(fresh[k]), name) for k, name in MARKETS.items()))), "、")
    stale, dead = named(lambda f: ~f), ~F.greatest(*fresh.values())
    closes = [F.when(fresh[k], F.concat(F.lit(f"{name}为 "), F.month(days[k]), F.lit("月"), F.day(days[k]), F.lit("日 收盘"))) for k, name in MARKETS.items()]
    note = F.when(dead, ALL_STALE).when(stale != "", F.concat(stale, F.lit(SOME_STALE))).otherwise("")
    spoken = F.when(dead, ALL_STALE_SPOKEN).otherwise(F.array_join(F.array_compact(F.array(F.when(stale != "", F.concat(stale, F.lit(STALE))), *closes)), "；"))
    return F.struct(named(lambda f: f).alias("fresh"), dead.alias("all_stale"), note.alias("note"), spoken.alias("spoken"))
