"""What titles of candidates for a listing say, as they are written."""

from pyspark.sql import functions as F

from feedmill.functions import listings

# Title, summary; stage by words, stage shown, issue of the report.
STAGED = [
    ("甲公司：注册生效 即将上市", "", "stage-registered", "stage-registered", ""),
    ("乙公司：提交注册", None, "stage-registered", "stage-registered", ""),
    ("丙公司：已问询", "科创板", "stage-reviewing", "stage-reviewing", ""),
    ("丁公司：进度", "辅导机构：某证券｜辅导验收", "stage-coach-done", "stage-coach-done", ""),
    ("戊公司：辅导备案", "", "stage-tutoring", "stage-tutoring", ""),
    ("己公司：辅导备案", "报告: 辅导工作进展情况报告（第五期）", "stage-tutoring", "stage-tutoring-progress", "第五期"),
    ("庚公司 Pre-IPO", "辅导备案进展", "stage-tutoring", "stage-tutoring-progress", "进展中"),
    ("辛公司：登陆深交易所", "发行", "stage-listed", "stage-listed", ""),
    ("壬公司正式上市", "", "stage-listed", "stage-listed", ""),
    ("癸公司新品", "无关", "stage-tutoring", "", ""),
    (None, None, "stage-tutoring", "", ""),
]

# Title, summary; name, short name, city, board, exchange, line of business, progress.
NAMED = [
    ("广东甲芯片股份有限公司：辅导备案（拟创业板）", "注册地：广东深圳市｜状态：辅导", "广东甲芯片股份有限公司", "甲芯片", "深圳市", "创业板", "深交所", "半导体", "辅导备案"),
    ("深圳市乙药业（集团）有限公司：", "注册地: 广东省广州市番禺区|状态: 受理", "深圳市乙药业有限公司", "乙药业", "广州市", "", "", "", "受理"),
    ("【快讯】丙生物公司 北交所IPO过会", "注册地：广东", "丙生物公司 北交所IPO过会", "丙生物", "广东", "", "", "医药生物", ""),
    ("集团：拟登陆(拟 H股 )", "", "集团", "集团", "广东", "登陆(拟 H股", "境外（港股）", "", "拟登陆"),
    ("丁机床（拟沪主板）", None, "丁机床", "丁机床", "广东", "沪主板", "上交所", "装备制造", ""),
    (None, "注册地：湖南省长沙市", "", "", "南省长沙市", "", "", "", ""),
]

# Title, source, code, province, whether the code is known; action, sub.
DECIDED = [
    ("深圳甲公司辅导备案", "news", None, None, False, "keep", "ipo-tutoring"),
    ("深圳甲公司年报", "news", "300001", None, False, "finance", None),
    ("深圳甲公司定增与回购", "news", "300001", None, False, "keep", "szse"),
    ("乙公司公告（股票代码：688001）", "news", None, "广东", False, "keep", "sse"),
    ("乙公司公告", "news", "830001", None, True, "keep", "bse"),
    ("乙公司公告", "hkex-list", None, "GD", False, "keep", "hkex"),
    ("乙公司公告", "techcrunch", None, "Guangdong", False, "keep", "overseas"),
    ("乙公司回购", "sgx", None, "Guangdong", False, "finance", None),
    ("深圳甲公司辅导备案", "news", None, "湖南", True, "drop", None),
    ("丙公司招股", "news", None, None, False, "drop", None),
    ("广州丙公司年会", "news", None, "", None, "finance", None),
    ("东莞创业赛复赛路演", "news", None, None, False, "finance", None),
    ("东莞丁公司首发路演", "news", None, None, False, "keep", "ipo-tutoring"),
    (None, None, None, None, None, "drop", None),
]

# Text; stage, evidence.
GROWN = [
    ("新厂区正式投产", "landed", "投产"),
    ("拟在广州建设总部并计划2027年开业", "clue", None),
    ("项目已竣工，" + "设备安装调试全部结束运行情况良好" + "，预计明年扩建", "landed", "竣工"),
    ("存量产品业绩基准分批调整", "clue", None),
    ("电池正式量产", "landed", "量产"),
    ("项目获批并签约", "progress", "获批"),
    ("预计开业；" + "另外这一个项目在上个月的时候就已经" + "开工", "progress", "开工"),
    ("有意向", "clue", None),
    ("", "clue", None),
    (None, "clue", None),
]

COACHED = [("辅导备案", "辅导备案报告", "stage-tutoring", True), ("辅导验收", None, "stage-coach-done", True), ("辅导工作完成", "辅导工作完成报告", "stage-coach-done", True), ("撤回辅导备案", "", "stage-tutoring", False), ("辅导备案", "辅导进展情况报告", "stage-tutoring", False), (None, None, "stage-tutoring", True)]

def values(spark, rows, names, *columns):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + names)
    return [tuple(r)[1:] for r in sorted(frame.select("i", *columns).collect(), key=lambda r: r.i)]


def test_stages(spark):
    title, summary, none = F.col("t"), F.col("s"), F.lit(None).cast("string")
    got = values(spark, [r[:2] for r in STAGED], "t string, s string", listings.infer_stage(title, summary), listings.display_stage(none, title, summary), listings.report_issue(F.concat_ws(" ", title, summary)), listings.is_routine(title, summary), listings.stage_of(F.lit("stage-listed"), title, summary))
    assert got == [(*r[2:], r[4] != "", "stage-listed") for r in STAGED]


def test_names(spark):
    title, summary = F.col("t"), F.col("s")
    company, board = listings.company_name(title), listings.planned_board(title)
    got = values(spark, [r[:2] for r in NAMED], "t string, s string", company, listings.short_name(title), listings.city_of(summary), board, listings.board_exchange(board), listings.industry(company), listings.progress(title, summary))
    assert got == [tuple(r[2:]) for r in NAMED]


def test_decisions(spark):
    none = F.lit(None).cast("string")
    found = listings.decide(F.col("t"), none, none, F.col("s"), F.col("c"), F.col("p"), F.col("k"))
    assert values(spark, [r[:5] for r in DECIDED], "t string, s string, c string, p string, k boolean", found["action"], found["sub"]) == [tuple(r[5:]) for r in DECIDED]


def test_maturity(spark):
    found = listings.maturity(F.col("t"))
    assert values(spark, [r[:1] for r in GROWN], "t string", found["stage"], found["evidence"]) == [tuple(r[1:]) for r in GROWN]


def test_register(spark):
    got = values(spark, [r[:2] for r in COACHED], "s string, r string", listings.coach_stage(F.col("s")), listings.coach_kept(F.col("s"), F.col("r")))
    assert got == [tuple(r[2:]) for r in COACHED]
