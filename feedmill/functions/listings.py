"""What titles of candidates for a listing say, as Columns: stage, issue of a report, names, places, line of business, how far a matter has come, and where an item goes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmill.functions import filings, lexicon
from feedmill.functions.text import bound

# Stages in the order in which their words decide, their worth, and what shows that a text names a stage at all.
STAGES = {
    "stage-registered": "注册生效 注册获准 同意注册 注册结果 注册批准 注册完成 注册通过 过会 核准 提交注册 上市委会议通过".split(),
    "stage-reviewing": "受理 问询 上会 审核 上市委 反馈意见 暂缓审议".split(),
    "stage-coach-done": "辅导验收 辅导完成 辅导工作完成 验收通过 已完成辅导".split(),
    "stage-tutoring": "辅导备案 IPO辅导 辅导机构 辅导协议 股份制改造 备案登记 pre-?ipo".split(),
    "stage-listed": "挂牌 发行结果 中签结果 敲钟 首日 登陆(沪|深|京|港)交易所 上市".split(),
}
FIRST_STAGE, ROUTINE_STAGE = "stage-tutoring", "stage-tutoring-progress"
WORTH = {"stage-tutoring": 5, "stage-coach-done": 4, "stage-registered": 3, "stage-reviewing": 2, "stage-listed": 1}
STAGE_HINTS = "注册 过会 核准 受理 问询 上会 审核 上市委 辅导 备案 招股 发行 申购 中签 挂牌 上市 pre-?ipo".split()
REPORT, ISSUE, ONGOING = "辅导[^，。；|]{0,4}进展", r"第\s*([0-9一二三四五六七八九十百]+)\s*期", "进展中"
COACH_STAGES = {"辅导备案": "stage-tutoring", "辅导验收": "stage-coach-done", "辅导工作完成": "stage-coach-done"}
# Boards by exchange, and lines of business in order of precedence.
BOARDS = {"北交所": "北交 新三板".split(), "深交所": "创业 深主 深市 中小".split(), "上交所": "科创 沪主 沪市".split(), "境外（港股）": "港 H股 红筹 HK".split(), "境外（美股）": "美 NASDAQ NYSE".split(), "A股": "A股 主板".split()}
INDUSTRIES = {
    "半导体": "半导体 芯片 集成电路 IC".split(),
    "医药生物": "生物 医药 制药 医疗 基因 疫苗 器械".split(),
    "化工新材料": "新材料 化工 化学 高分子".split(),
    "新能源": "新能 锂电 光伏 储能 电池 电气 充电 电力".split(),
    "科技": "智能 机器人 自动化 人工 软件 数据 云 信息 网络 科技 电子 光电 通信 计算".split(),
    "汽车": "汽车 轮胎 零部件".split(),
    "装备制造": "装备 机械 重工 机床".split(),
    "食品饮料": "食品 饮料 农 牧 渔 酒 乳 糖".split(),
    "金融": "金融 证券 银行 保险 基金 资本 投资".split(),
    "文化传媒": "传媒 文化 影 视 游戏 出版 教育".split(),
    "房地产建筑": "地产 置业 建 筑 装饰 物业 园林".split(),
    "物流运输": "物流 运 航 港 铁路 交通".split(),
    "纺织服装": "纺 服 鞋 皮革".split(),
    "金属冶炼": "钢铁 金属 矿 有色".split(),
}
# What a short name leaves out.
PLACES = "北京 上海 天津 重庆 广东 广州 深圳 珠海 佛山 东莞 中山 惠州 江门 肇庆 汕头 湛江 茂名 清远 韶关 梅州 河源 阳江 潮州 揭阳 云浮 汕尾".split()
TAIL_BOARDS = "北交所 上交所 深交所 科创板 创业板 主板".split()
TAIL_STAGES = "辅导备案 辅导验收 辅导工作完成报告 辅导完成 注册生效 同意注册 注册发行 问询中 已问询 受理 过会 挂牌 上市 IPO".split()
LEGAL_FORMS = "股份有限公司 股份有限责任公司 有限责任公司 有限公司 集团公司 控股公司 公司 集团".split()
# What makes an item one of the region, of a coming listing, of an exchange, or of finance alone.
PROVINCE, PROVINCE_NAMES = "广东", "^广东|^GD$|guangdong"
REGION = "广东 深圳 广州 珠海 佛山 东莞 中山 惠州 江门 肇庆 汕头 湛江 茂名 韶关 河源 梅州 清远 潮州 揭阳 云浮 南沙 前海".split()
COMING = ["辅导", "备案", "招股", "过会", "上市委", "注册生效", "询价", "申购", "(?:IPO|新股|首发|网上|网下|发行)路演", "路演(?:推介|询价)", "拟登陆", "pre-?ipo", "ipo"]
EXCHANGE_EVENTS = "限售 解禁 定增 增发 可转债 新股上市 上市公告 募资 配股 转板".split()
FINANCE = "年报 季报 中报 财报 利润分配 分红派息 分红 并购 重组 关联交易 担保 诉讼 澄清 停牌 复牌 减持 增持 回购".split()
ABROAD = "techcrunch eu-startups crunchbase overseas 境外 nasdaq sgx".split()
HONG_KONG = r"hkex hk 港交 hong\s*kong".split()
# What has been done, what is under way, what is still to come, and how near that must stand.
LANDED = "开业 投產 投产 上線 上线 竣工 驗收 验收 交付 通航 通車 通车 封顶 封頂 揭牌 掛牌 挂牌 试运行 試運行 首航 首店 落成 建成 (?<![存库批])量产 量產 开工投产 正式成立 登记成立 登記成立".split()
UNDER_WAY = "招标 招標 中标 中標 获批 獲批 批复 批復 核准 备案 備案 受理 立项 立項 签约 簽約 开工 動工 动工 启动 啟動 试点 試點 入选 入選 获准 獲准 增资 增資 注资 注資 申报 申報 报批 報批 过会 過會 注册生效 註冊生效".split()
TO_COME = "拟 擬 計劃 计划 規劃 规划 預計 预计 將于 将于 將在 将在 有望 籌備 筹备 意向 研究 探索 征求 徵求 草拟 草擬 目標 目标 爭取 争取 力争 力爭 谋 謀 预算 預算 预计于 待 推进前期 前期工作".split()
NEAR = 14


@dataclass(frozen=True)
class Listing:
    """What the rules on listings read: words of stages and what shows that a text names one, reports, names, boards, lines of business, places, what makes an item one of the region, a coming listing, an event of an exchange or finance, and how far a matter has come."""

    stages: Mapping[str, Sequence[str]] = field(default_factory=lambda: STAGES)
    hints: Sequence[str] = tuple(STAGE_HINTS)
    first: str = FIRST_STAGE
    routine: str = ROUTINE_STAGE
    report: str = REPORT
    issue: str = ISSUE
    numbered: tuple[str, str] = ("第", "期")
    ongoing: str = ONGOING
    coach: Mapping[str, str] = field(default_factory=lambda: COACH_STAGES)
    withdrawn: str = "撤回"
    report_on: str = "进展"
    colon: str = "："
    boards: Mapping[str, Sequence[str]] = field(default_factory=lambda: BOARDS)
    industries: Mapping[str, Sequence[str]] = field(default_factory=lambda: INDUSTRIES)
    places: Sequence[str] = tuple(PLACES)
    place_ends: str = "省|市"
    tail_boards: Sequence[str] = tuple(TAIL_BOARDS)
    tail_words: Sequence[str] = ("IPO", "上市")
    tail_stages: Sequence[str] = tuple(TAIL_STAGES)
    legal_forms: Sequence[str] = tuple(LEGAL_FORMS)
    registered_at: str = "注册地"
    status: str = "状态"
    plans: str = "拟"
    city: str = r"([\x{4e00}-\x{9fa5}]{2,4}市)"
    province: str = PROVINCE
    province_names: str = PROVINCE_NAMES
    region: Sequence[str] = tuple(REGION)
    coming: Sequence[str] = tuple(COMING)
    events: Sequence[str] = tuple(EXCHANGE_EVENTS)
    finance: Sequence[str] = tuple(FINANCE)
    abroad: Sequence[str] = tuple(ABROAD)
    hong_kong: Sequence[str] = tuple(HONG_KONG)
    landed: Sequence[str] = tuple(LANDED)
    under_way: Sequence[str] = tuple(UNDER_WAY)
    to_come: Sequence[str] = tuple(TO_COME)
    near: int = NEAR


CHINESE = Listing()


def _joined(*texts: Column) -> Column:
    return F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))


def infer_stage(title: Column, excerpt: Column, v: Listing = CHINESE) -> Column:
    """Stage by the first list of words that hits; tutoring where none does."""
    return lexicon.first_match(_joined(title, excerpt), v.stages, v.first)


def stage_of(given: Column, title: Column, summary: Column, v: Listing = CHINESE) -> Column:
    """The given stage if it is one, else by words; '' where no word tells of a stage."""
    return F.when(given.isin(*v.stages), given).when(lexicon.hits(_joined(title, summary), v.hints), infer_stage(title, summary, v)).otherwise("")


def report_issue(text: Column, v: Listing = CHINESE) -> Column:
    """Issue of a progress report as written, ONGOING without a number, '' for other texts."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), v.issue, 1)
    return F.when(~F.coalesce(text.rlike(v.report), F.lit(False)), "").when(number == "", v.ongoing).otherwise(F.concat(F.lit(v.numbered[0]), number, F.lit(v.numbered[1])))


def is_routine(title: Column, excerpt: Column, v: Listing = CHINESE) -> Column:
    """Whether a text is a periodical progress report of tutoring."""
    return (infer_stage(title, excerpt, v) == v.first) & (report_issue(_joined(title, excerpt), v) != "")


def display_stage(given: Column, title: Column, summary: Column, v: Listing = CHINESE) -> Column:
    """stage_of, with routine reports as a stage of their own."""
    return bound(stage_of(given, title, summary, v), lambda stage: F.when((stage == v.first) & (report_issue(_joined(title, summary), v) != ""), v.routine).otherwise(stage))


def coach_stage(status: Column, v: Listing = CHINESE) -> Column:
    """Stage by the status that a register of tutoring states; tutoring for unknown ones and null."""
    out = F.lit(v.first)
    for name, stage in v.coach.items():
        out = F.when(status == name, stage).otherwise(out)
    return out


def coach_kept(status: Column, report: Column, v: Listing = CHINESE) -> Column:
    """Whether a row of that register is news: neither withdrawn nor a progress report. Null counts as empty."""
    return ~F.contains(F.coalesce(status, F.lit("")), F.lit(v.withdrawn)) & ~F.contains(F.coalesce(report, F.lit("")), F.lit(v.report_on))


def company_name(title: Column, v: Listing = CHINESE) -> Column:
    """What stands before the first colon, without brackets and what they hold."""
    t = F.coalesce(title, F.lit(""))
    head = F.split_part(t, F.lit(v.colon), F.lit(1))
    s = F.regexp_replace(F.when(head == "", t).otherwise(head), r"[（(][^）)]*[)）]|[【\[][^】\]]*[\]】]", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def short_name(title: Column, v: Listing = CHINESE) -> Column:
    """A company's name without stage, place and legal form; the name where nothing would be left."""

    def made(full: Column) -> Column:
        words = "".join(f"(?:{w})?" for w in v.tail_words)
        s = F.trim(F.regexp_replace(full, rf"(?:{'|'.join(v.tail_boards)})?{words}(?:{'|'.join(v.tail_stages)})$", ""))
        s = F.trim(F.regexp_replace(s, rf"^(?:{'|'.join(v.places)})(?:{v.place_ends})?", ""))
        s = F.trim(F.regexp_replace(s, rf"(?:{'|'.join(v.legal_forms)})$", ""))
        return F.coalesce(F.nullif(s, F.lit("")), full)

    return bound(company_name(title, v), made)


def _field(text: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"{name}[:：]\s*([^｜|]+)", 1))


def city_of(summary: Column, v: Listing = CHINESE) -> Column:
    """City of the place of registration that a summary states; the province where it states none."""
    city = F.regexp_extract(F.regexp_replace(_field(summary, v.registered_at), f"^{v.province}(?:{v.place_ends})?", ""), v.city, 1)
    return F.when(city == "", v.province).otherwise(city)


def planned_board(title: Column, v: Listing = CHINESE) -> Column:
    """Board that a title plans for within parentheses; '' without."""
    return F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), rf"{v.plans}\s*([^）)]+?)\s*[）)]", 1))


def board_exchange(board: Column, v: Listing = CHINESE) -> Column:
    """Exchange of a board, '' for unknown ones."""
    return lexicon.first_match(board, v.boards, "")


def industry(company: Column, v: Listing = CHINESE) -> Column:
    """Line of business by a company's name, '' for unknown ones."""
    return lexicon.first_match(company, v.industries, "")


def progress(title: Column, summary: Column, v: Listing = CHINESE) -> Column:
    """What follows a title's colon up to parentheses, or the status that a summary states."""
    said = F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), rf"{v.colon}\s*([^（(]+)", 1))
    return F.when(said != "", said).otherwise(_field(summary, v.status))


def _apart(words: Sequence[str], markers: Sequence[str], near: int) -> str:
    """Pattern of the words where no marker stands wholly within so many characters before or after."""
    by_size: dict[int, list[str]] = {}
    for marker in markers:
        by_size.setdefault(len(marker), []).append(marker)
    groups = [(f"(?:{'|'.join(m)})", f".{{0,{near - n}}}") for n, m in sorted(by_size.items())]
    before, after = "|".join(m + gap for m, gap in groups), "|".join(gap + m for m, gap in groups)
    return f"(?s)(?<!{before})({'|'.join(words)})(?!{after})"


def maturity(text: Column, v: Listing = CHINESE) -> Column:
    """Struct of stage (landed, progress or clue) and evidence: the first word that no marker of the future stands near."""

    def made(t: Column) -> Column:
        done, begun = (F.regexp_extract(t, _apart(words, v.to_come, v.near), 1) for words in (v.landed, v.under_way))

        def told(x: Column) -> Column:
            stage = F.when(x["done"] != "", "landed").when(x["begun"] != "", "progress").otherwise("clue")
            return F.struct(stage.alias("stage"), F.coalesce(F.nullif(x["done"], F.lit("")), F.nullif(x["begun"], F.lit(""))).alias("evidence"))

        return bound(F.struct(done.alias("done"), F.when(done == "", begun).otherwise("").alias("begun")), told)

    return bound(F.coalesce(text, F.lit("")), made)


def of_region(province: Column, known_code: Column, text: Column, v: Listing = CHINESE) -> Column:
    """Whether an item is of the region: by its stated province, else by a known code, else by names of places."""
    stated = F.coalesce(province, F.lit("")) != ""
    return F.when(stated, province.rlike(f"(?i){v.province_names}")).otherwise(F.coalesce(known_code, F.lit(False)) | lexicon.hits(text, v.region))


def decide(title: Column, excerpt: Column, url: Column, source: Column, code: Column, province: Column, known_code: Column, exchanges: Mapping[str, Sequence[str]] = filings.EXCHANGES, v: Listing = CHINESE) -> Column:
    """Struct of action (keep, finance or drop) and sub: what a page on listings does with an item.

    Items of other regions drop. Coming listings are kept as such; reports of finance alone go to finance; the rest
    is kept under its market, told by the source or by the code, and goes to finance where neither tells.
    """
    text = _joined(title, excerpt, url)
    coming = lexicon.hits(text, v.coming) & ~lexicon.hits(text, v.finance)
    finance = lexicon.hits(text, v.finance) & ~lexicon.hits(text, v.events)
    market = F.when(lexicon.hits(source, v.abroad), "overseas").when(lexicon.hits(source, v.hong_kong), "hkex").otherwise(filings.exchange_of(F.coalesce(code, filings.stock_code(text)), exchanges))
    sub = F.when(coming, "ipo-tutoring").when(~finance, market)
    keep = of_region(province, known_code, text, v)
    return F.struct(F.when(~keep, "drop").when(sub.isNull(), "finance").otherwise("keep").alias("action"), F.when(keep, sub).alias("sub"))
