"""What is collected from pages: items of site layouts, listings read page by page, stores of documents."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark.sql import functions as F

from feedmill.plans.registry import query
from feedmill.sources import layouts, listing, manifest
from feedmill.storage import new_path

#: Two layouts that the pages have: all links of the navigation, and the longer ones of those that begin with a capital.
NAVIGATION = (
    layouts.Layout("all", within="li", base="https://pages.example", limit=1_000, most=10_000),
    layouts.Layout("long", within="li", words="^[A-Z]", skip=r"\.$", least=5, most=12, prefix="> ", once=True, limit=3),
)


@query(r"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'all' ELSE 'long' END AS layout, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>') AS found FROM pages),
u AS (SELECT page_id, layout, unnest(found) AS raw, unnest(range(len(found))) AS k FROM p),
l AS (SELECT page_id, layout, k, regexp_extract(raw, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(regexp_extract(raw, '>([^<]*)</a>$', 1), '(?i)&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM u),
f AS (SELECT * FROM l WHERE href <> '' AND title <> '' AND (layout = 'all' OR (length(title) BETWEEN 5 AND 12 AND regexp_matches(title, '^[A-Z]') AND NOT regexp_matches(href, '\.$')))),
g AS (SELECT * FROM f QUALIFY layout = 'all' OR row_number() OVER (PARTITION BY page_id, href ORDER BY k) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS position FROM g)
SELECT page_id AS page, position, title, CASE WHEN layout = 'all' AND NOT starts_with(href, 'http') THEN 'https://pages.example' || href ELSE href END AS url, CASE WHEN layout = 'long' THEN '> ' || title END AS excerpt FROM n WHERE layout = 'all' OR position < 3""")
def site_items(t):
    pages = t.pages.select(F.col("page_id").alias("page"), "html", F.when(F.col("page_id") % 2 == 0, "all").otherwise("long").alias("layout"))
    return layouts.site_items(pages, layouts.rules_table(t.pages.sparkSession, NAVIGATION)).drop("day")


ORDERS = layouts.Layout("orders", within="li", dates=r"(\d{4})-(\d\d)-(\d\d)", date_tag="span", limit=1_000_000_000)


def _order_pages(t):
    """Options of a listing of orders, newest first: two sources, a page for each three months, written by Spark."""
    day, last = F.to_date("o_orderdate"), t.orders.agg(F.max(F.to_date("o_orderdate")).alias("day")).first().day
    page = (F.floor(F.months_between(F.lit(last), day) / 3) + 1).cast("int")
    line = F.format_string('<li><a href="/orders/%d">order %d</a> <span>%s</span></li>', "o_orderkey", "o_orderkey", day.cast("string"))
    path = new_path(t.orders.sparkSession, "pages")
    t.orders.select((F.col("o_orderkey") % 2).alias("source"), page.alias("page"), line.alias("value")).repartition("source", "page").write.partitionBy("source", "page").text(path)
    listing.register(t.orders.sparkSession)
    return {"sources": json.dumps([{"id": str(s), "url": f"{path}/source={s}/page={{page}}", "layout": "orders"} for s in (0, 1)]), "layouts": json.dumps([asdict(ORDERS)])}


def _orders(rows):
    return rows.select("source_id", F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("o_orderkey"), "day")


@query("SELECT CAST(o_orderkey % 2 AS VARCHAR) AS source_id, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-15'")
def listing_since(t):
    rows = t.orders.sparkSession.read.format("listing").options(**_order_pages(t), max_pages="1000").load()
    return _orders(rows.where(F.col("day") >= F.lit("2000-06-15").cast("date")))


@query("SELECT CAST(o_orderkey % 2 AS VARCHAR) AS source_id, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def archive_stream(t):
    spark = t.orders.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    rows = spark.readStream.format("listing").options(**_order_pages(t), max_pages="10", checkpoint=state).load()
    stream = _orders(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.parquet(out)


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_acctbal > 5000 THEN '"large"' ELSE to_json(c_mktsegment) END AS segment, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer""")
def store_fields(t):
    spark, path, c = t.customer.sparkSession, new_path(t.customer.sparkSession, "store"), t.customer.withColumn("key", F.col("c_custkey").cast("string"))
    field = lambda rows, name, value: rows.select("key", F.lit(name).alias("field"), value.cast("string").alias("value"))
    first = field(c, "segment", F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))), field(c.where("c_custkey % 2 = 0"), "nation", F.col("c_nationkey"))
    with ThreadPoolExecutor(2) as both:  # two writers at once
        list(both.map(lambda rows: manifest.set_fields(rows, path), first))
    manifest.set_fields(field(c.where("c_acctbal > 5000"), "segment", F.lit('"large"')), path)
    manifest.set_fields(field(c.where("c_custkey % 10 = 0"), "nation", F.lit(None)), path)
    manifest.compact(spark, path)
    return manifest.documents(spark, path).select("key", F.col("fields")["segment"].alias("segment"), F.col("fields")["nation"].alias("nation"))
