"""Codes, names and days of filings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions import filings
from feedmill.plans.registry import query

_CODE = "printf('%06d', (o_orderkey * 7919) % 1000000)"


@query(f"""
WITH c AS (SELECT o_orderkey, {_CODE} AS code, CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE 'Some Co (' || {_CODE} || ') files' END AS said FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(code, '^(300|301|002|000|003)') THEN 'szse' WHEN regexp_matches(code, '^(600|601|603|605|688|689)') THEN 'sse' WHEN regexp_matches(code, '^(8|4|92)') THEN 'bse' END AS exchange, CASE WHEN o_orderkey % 4 <> 0 THEN code END AS found,
  CASE WHEN length(ltrim(code, '0')) >= 4 THEN ltrim(code, '0') ELSE '' END AS code_key FROM c""")
def codes_and_exchanges(t):
    code = F.lpad((F.col("o_orderkey") * 7919 % 1000000).cast("string"), 6, "0")
    said = F.when(F.col("o_orderkey") % 4 == 0, "none").otherwise(F.concat(F.lit("Some Co ("), code, F.lit(") files")))
    return t.orders.select("o_orderkey", filings.exchange_of(code).alias("exchange"), filings.stock_code(said).alias("found"), filings.code_key(F.concat(F.lit("No. "), code)).alias("code_key"))


@query("""
SELECT s_suppkey, 'supplier' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS key, CASE s_nationkey % 4 WHEN 0 THEN 'unverified' WHEN 1 THEN 'none' WHEN 2 THEN 'historical' ELSE 'current' END AS structure,
  CASE WHEN s_nationkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 AND s_acctbal > 0 THEN 'sure' ELSE 'open' END WHEN s_nationkey % 3 = 1 THEN 'open' ELSE '' END AS label FROM supplier""")
def companies(t):
    name = F.concat(F.regexp_replace("s_name", "#", "-W "), F.lit(" Holdings (Class A) Co., Limited"))
    text = F.when(F.col("s_nationkey") % 4 == 1, "plain").when(F.col("s_nationkey") % 4 == 2, "by contract, terminated").when(F.col("s_nationkey") % 4 == 3, "by contract")
    verdict = F.when(F.col("s_nationkey") % 3 == 0, "sure").when(F.col("s_nationkey") % 3 == 1, "open")
    label = filings.evidence_label(verdict, F.when(F.col("s_suppkey") % 2 == 0, "there"), F.when(F.col("s_acctbal") > 0, 2), F.lit("link"))
    return t.supplier.select("s_suppkey", filings.company_key(name).alias("key"), filings.structure(text, ["contract"]).alias("structure"), label.alias("label"))


@query("""
WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE day END AS written, day + 1 AS stamped, CAST(10000 + o_orderkey AS VARCHAR) AS application, CASE WHEN o_orderkey % 2 = 0 THEN 'gem' ELSE 'main' END AS board,
  date_diff('day', CASE WHEN o_orderkey % 5 = 0 THEN day - 40 ELSE day END, DATE '1998-12-31') BETWEEN 0 AND 30 OR date_diff('day', day + 9, DATE '1998-12-31') BETWEEN 0 AND 30 AS recent,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'keep' WHEN o_orderstatus = 'P' THEN 'move' ELSE 'drop' END AS action FROM o""")
def filing_days(t):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.when(key % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(key % 3 == 1, F.concat(F.lit("on "), F.date_format(day, "yyyyMMdd"))).otherwise("soon")
    link = F.concat(F.lit("https://x/app/"), F.when(key % 2 == 0, "gem").otherwise("sehk"), F.lit("/2024/"), (key + 10000).cast("string"), F.lit("/a.htm"))
    days = filings.window_days(F.when(key % 5 == 0, F.date_sub(day, 40)), day, F.date_add(day, 9))
    said = F.concat_ws(" ", "o_orderpriority", F.concat(F.lit("status="), F.col("o_orderstatus")))
    action = filings.routed(said, [("keep", ["1-URGENT", "2-HIGH"]), ("move", ["status=P"])], "drop")
    return t.orders.select(
        "o_orderkey", filings.day_of(text).alias("written"), filings.day_of_stamp(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + 17 * 3_600_000).alias("stamped"), filings.application_id(F.lit(None).cast("string"), link).alias("application"),
        filings.board(link).alias("board"), filings.in_any_window(days, F.lit("1998-12-31").cast("date"), 30).alias("recent"), action.alias("action"),
    )
