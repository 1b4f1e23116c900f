"""Vocabularies that rules read. Every rule takes its own as a parameter; those here are the defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# Words that name what an event is about, those among them that name only a place or an authority,
# wordings that count as one, stages, bodies, places, themes, and the units of a number.
ANCHORS = (
    "央行 人民银行 金融监管总局 金监总局 国务院 证监会 发改委 财政部 住建部 外汇局 美联储 "
    "房贷 按揭 抵押贷 个贷 住房贷款 房地产信贷 楼市 购房 房抵 存量房贷 商品房 公积金 缴存 "
    "消费贷 经营贷 小微贷 信贷 LPR 降息 降准 利率 贴息 普惠金融 普惠小微 普惠贷款 普惠信贷 政策性金融工具 特别国债 两重两新 "
    "理财 基金 黄金 保险 存款 资管 信托 REITs ETF 债基 私行 高净值 家族信托 客群 获客 新客 开户 代发 信用卡 养老 "
    "罚 处罚 违规 整改 通报 不良 逾期 违约 爆雷 IPO 上市 过会 注册 招股 申购 敲钟 北交所 科创板 创业板 广州 广东 大湾区 南沙 粤"
).split()
GENERIC = "央行 人民银行 金融监管总局 金监总局 国务院 证监会 发改委 财政部 住建部 外汇局 美联储 交易所 北交所 科创板 创业板 广州 广东 大湾区 南沙 粤".split()
SYNONYMS = (("个人住房贷款|住房贷款|住房按揭|住房抵押贷|个人住房按揭贷款", "房贷"), ("住房公积金|个人住房公积金", "公积金"), ("公募(?:基金)?", "基金"))
STAGES = "受理 问询 过会 提交注册 注册生效 辅导备案 招股 申购 敲钟 批复 落地 实施 施行 试点 扩围 首单 出台 印发 发布 约谈 处罚 罚款 通报 整改 下调 上调 降息 降准 加息 受理申请 正式生效 窗口指导".split()
BODIES = "央行 人民银行 金融监管总局 金监总局 国务院 证监会 发改委 财政部 住建部 外汇局 美联储 交易所 北交所 科创板 创业板 广州 广东 南沙 大湾区".split()
PLACES = "广州 广东 大湾区 南沙 粤".split()
THEMES = {
    "住房金融": "房贷 按揭 公积金 购房 楼市 住房 房抵 存量房贷 商品房 抵押贷".split(),
    "利率流动性": "LPR 降息 降准 利率 贴息 存款".split(),
    "监管合规": "罚 处罚 违规 整改 通报 不良 逾期 违约 爆雷 约谈".split(),
    "资本市场": "IPO 上市 过会 注册 招股 申购 敲钟 北交所 科创板 创业板".split(),
    "财富管理": "理财 基金 黄金 保险 资管 信托 债基 ETF REITs 公募".split(),
    "私行客群": "私行 高净值 家族信托 客群 获客 新客 开户".split(),
    "消费信贷": "消费贷 经营贷 小微 信用卡 普惠金融 普惠小微 普惠贷款 普惠信贷".split(),
    "广州本地": "广州 广东 大湾区 南沙 粤".split(),
    "科技金融": "科技金融 数字人民币 金融科技".split(),
}
ANCHOR_UNITS = "年|个月|%|％|元|万元|亿元|万亿元|万亿|基点|bp|BP|倍|个百分点|‰"
FACT_UNITS = "个百分点|万亿元|万亿|亿元|万元|(?:个)?基点|bp|BP|年|个月|月|日|%|％|元|倍|‰|家|户|笔"


@dataclass(frozen=True)
class Events:
    """What the rules of event identity read."""

    anchors: Sequence[str] = tuple(ANCHORS)
    generic: Sequence[str] = tuple(GENERIC)
    synonyms: Sequence[tuple[str, str]] = SYNONYMS
    stages: Sequence[str] = tuple(STAGES)
    bodies: Sequence[str] = tuple(BODIES)
    places: Sequence[str] = tuple(PLACES)
    themes: Mapping[str, Sequence[str]] = field(default_factory=lambda: THEMES)
    anchor_units: str = ANCHOR_UNITS
    fact_units: str = FACT_UNITS
    short_units: Mapping[str, str] = field(default_factory=lambda: {"万亿元": "万亿"})
    period: str = r"^#(?:\d{4}年|\d{1,2}月(?:\d{1,2}日)?|\d{1,2}季度|Q[1-4])$"
