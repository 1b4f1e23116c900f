"""Leads, their changes and reports, regions and listings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions import filings
from feedmill.operators import leads
from feedmill.plans.listings import _dealt, _sql
from feedmill.plans.registry import query
from feedmill.sources import listings

_TODAY = "DATE '2024-01-20'"
_LEADS = f"""
WITH l AS (SELECT 'L' || c_custkey AS lead_id, CASE c_custkey % 3 WHEN 0 THEN 'sure' WHEN 1 THEN '' END AS label, c_custkey % 4 <> 0 AS connected, CASE WHEN c_custkey % 5 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) END AS submitted,
  TIMESTAMP '2024-01-10 08:00:00' + to_hours(CAST(c_custkey % 200 AS INT)) AS found_at, CASE WHEN c_custkey % 7 = 0 THEN 'us' ELSE 'hk' END AS market FROM customer),
c AS (SELECT 'L' || o_custkey AS lead_id, max(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(o_orderkey % 400 AS INT))) AS changed_at, bool_or(o_orderkey % 3 = 0) AS is_new, list_sort(list_distinct(list(CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END) FILTER (o_orderkey % 3 = 1))) AS fields FROM orders GROUP BY 1),
w AS (SELECT l.*, changed_at, coalesce(is_new, false) AS is_new, coalesce(array_to_string(fields, ','), '') AS fields, coalesce(CAST(changed_at AS DATE), submitted) AS active,
  coalesce({_TODAY} - coalesce(submitted, CAST(found_at AS DATE)) BETWEEN 0 AND 7, false) OR coalesce({_TODAY} - CAST(changed_at AS DATE) BETWEEN 0 AND 7, false) AS recent FROM l LEFT JOIN c USING (lead_id))"""


def _leads(t):
    key = F.col("c_custkey")
    hours = lambda start, n: (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), n.cast("int")))
    rows = t.customer.select(F.concat(F.lit("L"), key.cast("string")).alias("lead_id"), F.when(key % 3 == 0, "sure").when(key % 3 == 1, "").alias("label"), (key % 4 != 0).alias("connected"),
                             F.when(key % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int"))).alias("submitted"), hours("2024-01-10 08:00:00", key % 200).alias("found_at"), F.when(key % 7 == 0, "us").alias("market"))
    order = F.col("o_orderkey")
    changes = t.orders.select(F.concat(F.lit("L"), F.col("o_custkey").cast("string")).alias("lead_id"), hours("2024-01-01 00:00:00", order % 400).alias("at"), _dealt("o_orderkey", ["added", "changed", "removed"]).alias("type"), F.col("o_orderstatus").alias("field"))
    return leads.with_changes(rows, changes)


@query(_LEADS + """, r AS (SELECT 'L' || s_suppkey AS lead_id, CASE s_suppkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'd' END || s_suppkey AS url FROM supplier WHERE s_suppkey % 3 < 2)
SELECT lead_id, is_new, fields, market, coalesce(url, '../redchip/r/' || lead_id || '.html') AS report_url, lead_id IN (SELECT 'L' || n_nationkey FROM nation) AS matched, active FROM w LEFT JOIN r USING (lead_id) WHERE recent AND label <> ''""")
def lead_panel(t):
    kind = _dealt("s_suppkey", ["manual", "deep", "other"])
    one = t.supplier.select(F.concat(F.lit("L"), F.col("s_suppkey").cast("string")).alias("lead_id"), F.concat(F.substring(kind, 1, 1), F.col("s_suppkey").cast("string")).alias("url"), kind.alias("kind"))
    worse = one.where("kind = 'manual'").withColumns({"kind": F.lit("deep"), "url": F.lit("a")})
    matched = t.nation.select(F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("lead_id"))
    out = leads.panel(_leads(t), one.unionByName(worse), matched, F.lit("2024-01-20").cast("date"))
    return out.select("lead_id", "is_new", F.array_join("changed_fields", ",").alias("fields"), "market", "report_url", "matched", "active")


@query(_LEADS + "SELECT lead_id, active FROM w WHERE coalesce(label, '') = '' AND connected AND recent ORDER BY active DESC NULLS LAST, lead_id LIMIT 20")
def adjacent_leads(t):
    return leads.adjacent(_leads(t), F.lit("2024-01-20").cast("date")).select("lead_id", "active")


@query(_LEADS + "SELECT market, count(CASE WHEN label <> '' THEN 1 END) AS leads, CAST(max(greatest(changed_at, found_at)) AS DATE) AS last_day FROM w GROUP BY market")
def lead_ledger(t):
    return leads.ledger(_leads(t)).select("market", "leads", F.to_date("last_at").alias("last_day"))


@query(r"""
WITH s AS (SELECT s_suppkey, s_name, s_suppkey % 3 AS r, CASE WHEN s_suppkey % 5 > 0 THEN n_name ELSE '' END AS city, CASE WHEN s_suppkey % 7 > 0 THEN n_name || CASE WHEN s_suppkey % 2 = 0 THEN '市' ELSE '' END || ' ' || r_name ELSE '' END AS addr, s_name || ' of ' || (2018 + s_suppkey % 9) AS title,
  CASE WHEN s_suppkey % 4 > 0 THEN CASE WHEN s_suppkey % 4 = 1 THEN strftime(DATE '2024-01-01' + CAST(s_suppkey % 30 AS INT), '%Y%m%d') ELSE strftime(DATE '2024-01-01' + CAST(s_suppkey % 30 AS INT), '%Y-%m-%d') END END AS day FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
n AS (SELECT *, starts_with(addr, 'NATION_1') OR contains(addr, 'NATION_2市') AS near, contains(city, 'NATION_1') OR contains(city, 'NATION_2') AS mine FROM s)
SELECT s_suppkey, CASE WHEN r = 1 THEN CASE WHEN city <> '' THEN CASE WHEN mine THEN 'gz' ELSE 'gd' END WHEN near OR starts_with(addr, 'NATION_2') THEN 'gz' ELSE 'gd' END WHEN addr = '' THEN '' WHEN near OR starts_with(addr, 'NATION_2') THEN 'gz' WHEN contains(addr, 'REGION_1') THEN 'gd' ELSE 'nation' END AS region,
  s_suppkey % 4 = 0 AND 2018 + s_suppkey % 9 <= 2022 AS stale, coalesce(regexp_matches(day, '^\d{4}-\d{2}-\d{2}$'), false) AS listing FROM n""")
def regions(t):
    key = F.col("s_suppkey")
    rows = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    registered = F.when(key % 3 == 1, True).when(key % 3 == 2, False)
    city = F.when(key % 5 > 0, F.col("n_name")).when(key % 2 == 0, "")
    address = F.when(key % 7 > 0, F.concat("n_name", F.when(key % 2 == 0, "市").otherwise(""), F.lit(" "), "r_name"))
    date = F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int"))
    day = F.when(key % 4 > 0, F.when(key % 4 == 1, F.date_format(date, "yyyyMMdd")).otherwise(date.cast("string")))
    stale = filings.has_stale_year(F.concat("s_name", F.lit(" of "), 2018 + key % 9), day, F.lit(2024))
    return rows.select("s_suppkey", filings.region_of(registered, city, address, ["NATION_1", "NATION_2"], "REGION_1").alias("region"), stale.alias("stale"), filings.is_listing(key.cast("string"), F.col("s_name"), day).alias("listing"))


@query("""
SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS name, DATE '2024-01-01' + CAST(s_suppkey % 30 AS INT) AS listed, x AS exchange, CASE WHEN x <> 'SZSE' THEN '广东省' END AS area FROM supplier, (VALUES ('SSE', 0), ('BSE', 1), ('SZSE', 2)) v(x, k)
WHERE s_suppkey % 30 >= 9 AND (k = 2 OR s_nationkey % 2 = 0)""")
def exchange_listings(t):
    code, day = F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 30).cast("int"))
    area = F.when(F.col("s_nationkey") % 2 == 0, "广东省").otherwise("湖南省")
    record = lambda **fields: F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    sse = F.concat(F.lit('cb123({"pageHelp":{"data":['), record(A_STOCK_CODE=code, FULL_NAME=F.lit(""), COMPANY_ABBR=F.col("s_name"), LIST_DATE=F.date_format(day, "yyyyMMdd"), AREA_NAME_DESC=area), F.lit("]}})"))
    bse = F.concat(F.lit('null([{"listInfo":{"content":['), record(stockCode=code, stockName=F.col("s_name"), listDate=day.cast("string"), registerAddress=area), F.lit("]}}])"))
    szse = F.concat(F.lit('[{"metadata":{"pagecount":3},"data":['), record(agdm=code, agjc=F.concat(F.lit("<a href='x'>"), F.col("s_name"), F.lit("</a>")), agssrq=day.cast("string")), F.lit("]}]"))
    broken = t.supplier.select(F.lit("<html>busy</html>").alias("answer")).limit(3)
    since = F.lit("2024-01-10").cast("date")
    out = None
    for service, answer in (("SSE", sse), ("BSE", bse), ("SZSE", szse)):
        part = listings.listings(t.supplier.select(answer.alias("answer")).unionByName(broken), "answer", service, since, "广东")
        out = part if out is None else out.unionByName(part)
    return out
