"""Picks that relax, records that may be damaged, lookups that learn, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.operators import ingest, relax
from feedmill.plans.registry import query
from feedmill.storage import new_path
from feedmill.streaming import lookup



def _levels():
    """Conditions from strict to lax."""
    price, unshipped = F.col("o_totalprice"), F.col("o_orderstatus") == "O"
    return [price > 450_000, unshipped & (price > 300_000), unshipped, F.col("o_orderkey") % 2 == 0]


_LEVEL = "CASE WHEN o_totalprice > 450000 THEN 0 WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 1 WHEN o_orderstatus = 'O' THEN 2 WHEN o_orderkey % 2 = 0 THEN 3 END"


@query(f"""
WITH l AS (SELECT o_custkey % 50 AS team, o_orderkey, o_totalprice, {_LEVEL} AS level FROM orders)
SELECT team, o_orderkey, level FROM l WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY team ORDER BY level, o_totalprice DESC, o_orderkey) <= 25""")
def relaxed_pool(t):
    rows = t.orders.withColumn("team", F.col("o_custkey") % 50)
    return relax.relaxed(rows, _levels(), ["team"], [F.desc("o_totalprice"), "o_orderkey"], 25).select("team", "o_orderkey", "level")


@query(f"""
WITH l AS (SELECT o_custkey % 50 AS team, o_orderkey, {_LEVEL} AS level FROM orders), n AS (SELECT team, level, count(*) AS n FROM l WHERE level IS NOT NULL GROUP BY ALL),
b AS (SELECT team, level, coalesce(sum(n) OVER (PARTITION BY team ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT l.team, o_orderkey, l.level FROM l JOIN b ON l.team = b.team AND l.level = b.level WHERE before < 20""")
def relaxed_levels(t):
    return relax.relaxed_levels(t.orders.withColumn("team", F.col("o_custkey") % 50), _levels(), ["team"], 20).select("team", "o_orderkey", "level")


#: Fields of an event's properties.
PROPS = (ingest.Field("id", "bigint", required=True), ingest.Field("k", "bigint", 0, least=10), ingest.Field("name", "string", "none"), ingest.Field("tags", "array<string>", ()), ingest.Field("from", "date", instead="to"), ingest.Field("to", "date", instead="from"))
# What becomes of an event's properties, by event_id % 12.
_DAMAGE = ["{}", "{},,", '"id": {id}', "[{}]", '{{"id": {id}, "k": {k}, "name": 7, "from": "2024-02-30", "to": "2024-02-03"}}', '{{"id": "{id}", "k": {k}}}', '{{"id": {id}, "k": "{k}", "more": [{k}]}}', '{{"id": {id}, "k": {k}, "tags": ["a", "b"], "name": "n{k}"}}', '{{"id": {id}, "k": null, "tags": "a", "name": ""}}', '{{"id": {id}, "k": {k}', '{{"id": {id}, "k": {k}, "from": "2024-03-0{id}"}}', '{{"id": {id}.0, "k": {k}, "from": 20240301, "to": "2024-03-01"}}']


@query(r"""
WITH d AS (SELECT event_id AS id, event_id % 12 AS how, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), n AS (SELECT *, CASE WHEN how IN (4, 7, 11) THEN greatest(k, 0) ELSE 0 END AS kk FROM d)
SELECT id AS event_id, CASE how WHEN 0 THEN 'no id' WHEN 1 THEN 'no JSON' WHEN 2 THEN 'no object' WHEN 3 THEN 'no object' WHEN 5 THEN 'no id' WHEN 9 THEN 'no JSON' ELSE '' END AS reasons,
  CASE WHEN how IN (4, 6, 7, 8, 10, 11) THEN id END AS id, CASE WHEN how IN (4, 7, 10, 11) THEN CASE WHEN k >= 10 THEN k ELSE 0 END WHEN how IN (6, 8) THEN 0 END AS k,
  CASE WHEN how = 7 THEN 'n' || k WHEN how IN (4, 6, 8, 10, 11) THEN 'none' END AS name, CASE WHEN how = 7 THEN 'a,b' WHEN how IN (4, 6, 8, 10, 11) THEN '' END AS tags,
  CASE WHEN how = 4 THEN DATE '2024-02-03' WHEN how = 11 THEN DATE '2024-03-01' WHEN how = 10 AND id < 10 AND id > 0 THEN CAST('2024-03-0' || id AS DATE) END AS since,
  array_to_string(list_filter([CASE WHEN how = 5 THEN 'id' END, CASE WHEN how = 6 OR (how IN (0, 4, 5, 7, 10, 11) AND k < 10) THEN 'k' END, CASE WHEN how IN (4, 8) THEN 'name' END, CASE WHEN how = 8 THEN 'tags' END, CASE WHEN how IN (4, 11) OR (how = 10 AND id >= 10) THEN 'from' END], lambda x: x IS NOT NULL), ',') AS bad, how = 6 AS more FROM n""")
def ingested_props(t):
    k, text = F.get_json_object("props", "$.k"), F.col("props")
    for how, shape in enumerate(_DAMAGE):
        made = F.col("props") if shape == "{}" else F.concat(F.col("props"), F.lit(",,")) if shape == "{},," else F.concat(F.lit("["), "props", F.lit("]")) if shape == "[{}]" else F.replace(F.replace(F.lit(shape.replace("{{", "{").replace("}}", "}")), F.lit("{id}"), F.col("event_id").cast("string")), F.lit("{k}"), k)
        text = F.when(F.col("event_id") % len(_DAMAGE) == how, made).otherwise(text)
    found = ingest.ingested(t.events.select("event_id", text.alias("json")), "json", PROPS)
    r = F.col("record")
    return found.select("event_id", F.array_join("reasons", ",").alias("reasons"), r["id"].alias("id"), r["k"].alias("k"), r["name"].alias("name"), F.array_join(r["tags"], ",").alias("tags"), r["from"].alias("since"), F.array_join("bad", ",").alias("bad"), F.coalesce(F.map_contains_key("rescued", "more"), F.lit(False)).alias("more"))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS code, CASE WHEN s_suppkey % 10 = 0 THEN 'registry' WHEN s_nationkey % 5 <> 2 THEN n_name END AS province, CASE WHEN s_suppkey % 10 = 0 THEN 0 WHEN s_nationkey % 5 = 2 THEN 3 WHEN s_nationkey % 5 < 2 THEN s_nationkey % 5 + 1 ELSE 1 END AS asked
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def learned_provinces(t):
    """Suppliers come three times; who is of a nation n with n % 5 = 0, 1 or 2 is found after so many failures, the last not within three."""
    spark, path = t.supplier.sparkSession, new_path(t.supplier.sparkSession, "provinces")
    source, out, state, log = (new_path(spark, name) for name in ("codes", "resolved", "state", "asked"))
    codes = t.supplier.select(F.col("s_suppkey").cast("string").alias("code"))
    for _ in range(3):
        codes.coalesce(1).write.mode("append").parquet(source)
    registry = t.supplier.where("s_suppkey % 10 = 0").select(F.col("s_suppkey").cast("string").alias("code"), F.lit("registry").alias("province"))
    answers = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("code"), (F.col("s_nationkey") % 5).alias("k"), "n_name")

    def ask(missing, number):
        missing.withColumn("turn", F.lit(number)).write.mode("append").parquet(log)
        failing = (F.col("k") == 2) | ((F.col("k") < 2) & (F.col("k") > number - 1) & (F.lit(number) < F.col("k")))
        return missing.join(answers, "code").select("code", F.when(~failing, F.col("n_name")).alias("province"))

    stream = spark.readStream.schema(codes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    lookup.resolve_stream(stream, registry, path, ask, out, state).awaitTermination()
    asked = spark.read.parquet(log).groupBy("code").agg(F.count("*").alias("asked"))
    last = spark.read.parquet(out).where("batch = 2").select("code", "province")
    return last.join(asked, "code", "left").select("code", "province", F.coalesce("asked", F.lit(0)).alias("asked"))
