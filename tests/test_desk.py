"""What items mean for a desk, cards of market reports, and regions, as they are written."""

import datetime

from pyspark.sql import functions as F

from feedmill.functions import desk, filings, market, text
from tests.test_listing_titles import values

# Title, tag; tags rolled up, lines reached, themes of gz-credit, themes of all lines.
FILED = [
    ("公积金贷款利率下调", "粤", "信贷,粤", "gz-credit", "公积金,利率,贷款", "公积金,利率,贷款"),
    ("黄金与养老", "跨境", "财富,客群,跨境", "gz-wealth", "", "黄金"),
    ("芯片企业股权融资担保", "信用卡", "信贷,私行,信用卡,客群", "gz-credit,gz-private", "融资担保", "融资担保,股权,芯片"),
    ("居民收入", None, "", "gz-customer", "", "居民收入,收入"),
    ("无关", "财富", "财富", "", "", ""),
    (None, None, "", "", "", ""),
]

# Text, source, column, locale; authority of issuer and source, action, its score, nearness.
WEIGHED = [
    ("央行发文降息", "pbc", "cn-finance", None, 0.95, 0.95, "policy_action", 0.9, 0.0),
    ("加拿大央行加息", "stcn", "cn-policy", "gz", 0.0, 0.9, "default", 0.5, 0.9),
    ("广东省工业和信息化厅处罚", "gd-gii", None, None, 0.8, 0.86, "risk_action", 0.85, 0.9),
    ("广州市商务局：同比增长", "blog", None, None, 0.8, 0.42, "data_context", 0.4, 1.0),
    ("协会年会", None, "cn-finance", None, 0.6, 0.6, "soft", 0.2, 0.0),
    (None, None, None, None, 0.0, 0.42, "default", 0.5, 0.0),
]

# Days of the three markets before 2024-03-02; those that are fresh, note, spoken.
CLOSED = [
    (["2024-03-01", "2024-03-01", "2024-03-02"], "A股、港股、美股", "", "A股为 3月1日 收盘；港股为 3月1日 收盘；美股为 3月2日 收盘"),
    (["2024-02-28", "2024-03-01", None], "港股", "A股、美股今日无隔夜行情，其余市场为最新收盘", "A股、美股今日无隔夜行情；港股为 3月1日 收盘"),
    ([None, "2024-03-03", "2024-02-01"], "", desk.ALL_STALE, desk.ALL_STALE_SPOKEN),
]

# Title; overview and sectors with the quote below, overview without quotes.
REPORTS = [
    ("恒生指数涨1.20%，内房股逆势走强，半导体股多，智谱跌超12%", "恒生指数收报100点（+1.20%）。", "内房股逆势走强|智谱跌超12%", "恒生指数涨1.20%"),
    ("恒生指数跌1.20%，内房股逆势走强，上证指数跌0.5%", "恒生指数跌1.20%，上证指数跌0.5%。", "内房股逆势走强", "恒生指数跌1.20%"),
    ("内房股逆势走强", None, None, None),
    (None, None, None, None),
]

# Registered, city, address; region.
PLACED = [(True, "广州市南沙", None, "gz"), (True, "深圳", "广州市", "gd"), (True, "", "湛江开发区", "gz"), (True, None, None, "gd"), (False, None, "广东省清远市", "gz"), (False, None, "广东深圳", "gd"), (None, "广州", "北京市", "nation"), (False, None, "", "")]


def test_departments_lines_and_themes(spark):
    title, tag = F.col("t"), F.col("g")
    columns = [desk.rolled_up(title, F.when(tag.isNotNull(), F.array(tag))), desk.lines_reached(title), desk.theme_keys(title, F.lit("gz-credit")), desk.theme_keys(title, F.lit(None).cast("string"))]
    assert values(spark, [r[:2] for r in FILED], "t string, g string", *(F.array_join(c, ",") for c in columns)) == [tuple(r[2:]) for r in FILED]


def test_weights(spark):
    said, act = F.col("t"), desk.action(F.col("t"))
    got = values(spark, [r[:4] for r in WEIGHED], "t string, s string, c string, l string", desk.issuer_authority(said), desk.source_authority(F.col("s"), F.col("c")), act["type"], act["score"], desk.nearness(said, F.col("l")))
    assert got == [tuple(r[4:]) for r in WEIGHED]


def test_markets(spark):
    rows = [tuple(d and datetime.date.fromisoformat(d) for d in r[0]) for r in CLOSED]
    status = desk.market_status(F.lit("2024-03-02").cast("date"), dict(zip(desk.MARKETS, map(F.col, "abc"), strict=True)))
    assert values(spark, rows, "a date, b date, c date", status["fresh"], status["note"], status["spoken"]) == [tuple(r[1:]) for r in CLOSED]


def test_cards(spark):
    clauses = F.transform(text.split_clauses(F.replace("t", F.lit("."), F.lit("\1"))), lambda c: F.replace(c, F.lit("\1"), F.lit(".")))
    quote = F.struct(F.lit("恒生指数").alias("name"), F.lit("100").alias("value"), F.lit("+1.20%").alias("change"), F.lit(1.2).alias("pct"))
    card, plain = (market.recap_card(clauses, quotes, ["恒生指数", "上证指数"], "涨|走强|反弹", "跌|走弱|下挫", "直播") for quotes in (F.array(quote), F.filter(F.array(quote), lambda q: F.lit(False))))
    assert values(spark, [r[:1] for r in REPORTS], "t string", card["overview"], F.array_join(card["sectors"], "|"), plain["overview"]) == [tuple(r[1:]) for r in REPORTS]


def test_regions(spark):
    region = filings.region_of(F.col("k"), F.col("c"), F.col("a"), ["广州", "湛江", "清远"], "广东")
    assert values(spark, [r[:3] for r in PLACED], "k boolean, c string, a string", region) == [tuple(r[3:]) for r in PLACED]
    years = [("2024 report", False), ("of 2021 and 2024", True), ("review 2022", True), ("in 1999.", True), (None, None)]
    assert values(spark, [y[:1] for y in years], "t string", filings.has_stale_year(F.col("t"), F.lit(None).cast("date"), F.lit(2024)))[:4] == [y[1:] for y in years[:4]]
