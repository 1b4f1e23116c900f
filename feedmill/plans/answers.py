"""Damaged answers made whole, and texts without what others told before, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions import echoes, jsonrepair
from feedmill.plans.registry import query

#: Sentences of the tables' languages: they end at full stops and may be cut at commas.
PROSE = echoes.Style(span=24, rest=40, ends=".。；", peel=".,，。；、")


@query(r"""
WITH d AS (SELECT event_id, event_id % 7 AS how, props, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN how = 5 THEN CAST(nullif(regexp_extract(left(props, length(props) - 2), ':\s*(\d*)$', 1), '') AS BIGINT) WHEN how = 6 THEN NULL ELSE k END AS k, CASE WHEN how = 4 THEN event_id END AS id, how <> 6 AS found FROM d""")
def repaired_props(t):
    how, p = F.col("event_id") % 7, F.col("props")
    damaged = (
        F.when(how == 1, F.replace(p, F.lit('"'), F.lit("'"))).when(how == 2, F.replace(p, F.lit("}"), F.lit(",}"))).when(how == 3, F.concat(F.lit("```json\n"), F.replace(p, F.lit('"'), F.lit("")), F.lit("\n```")))
        .when(how == 4, F.concat(F.lit('{"p": '), F.substring(p, F.lit(1), F.length(p) - 1), F.lit(' "id": '), F.col("event_id"))).when(how == 5, F.substring(p, F.lit(1), F.length(p) - 2)).when(how == 6, F.translate(p, "{}", "")).otherwise(p)
    )
    made = t.events.select("event_id", jsonrepair.repaired(damaged).alias("json"))
    number = lambda path: F.get_json_object("json", path).cast("long")
    return made.select("event_id", F.coalesce(number("$.k"), number("$.p.k")).alias("k"), F.coalesce(number("$.id"), number("$.p.id")).alias("id"), F.col("json").isNotNull().alias("found"))


@query()  # tests hold it against a quadratic search
def pruned_echoes(t):
    own = t.documents.where("doc_id is not null").select("doc_id", "text")
    before = own.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("told"))
    out = own.join(before, "doc_id").select("doc_id", echoes.without_echoes(F.col("text"), F.col("told"), PROSE).alias("r"))
    return out.select("doc_id", F.sha2("r.text", 256).alias("text_sha256"), "r.removed_chars", "r.removed_sentences", "r.trimmed_sentences", "r.skipped_numeric", "r.skipped_struct", F.size("r.echoes").cast("long").alias("echoes"))
