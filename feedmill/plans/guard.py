"""The guard of an issue's memory over parts as stories: brands are channels, parts of a month's day compete for its sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.operators import guard
from feedmill.plans.identity import PARTS
from feedmill.plans.registry import query

RULES = guard.Rules(kinds=(("policy", "PROMO"), ("market", "ECONOMY"), ("local", "red|blue")), generic=frozenset(PARTS.generic), period=PARTS.period)


def stories(t):
    """candidates, deliveries: a part a story of its brand's channel; two days of three are delivered."""
    k = F.col("p_partkey")
    rows = t.part.select(
        F.col("p_brand").alias("channel"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 31).cast("int")).alias("day"), F.when(k % 10 < 5, "must_read").when(k % 10 < 9, "insights").otherwise("risk").alias("section"), k.alias("pos"), F.col("p_size").alias("rank"),
        F.concat_ws(" ", "p_name", (F.col("p_size") % 7).cast("string"), F.lit("years")).alias("title"), F.concat_ws(" ", "p_type", "p_brand", (F.col("p_size") % 3).cast("string"), F.lit("percent")).alias("body"),
        F.concat(F.lit("u"), k % 97).alias("url"), (k % 100).cast("double").alias("score"), (k % 41 == 0).alias("override"), F.when(k % 4 == 0, "must_read").alias("tier"), F.concat(F.lit("run"), (k % 31) % 4).alias("run"),
    )
    days = rows.select("channel", "day", F.dayofmonth("day").alias("d")).distinct().where("d % 3 <> 0")
    return rows, days.select("channel", "day", F.when(F.col("d") % 5 > 0, F.concat(F.lit("run"), (F.col("d") - 1) % 4)).alias("run"))


@query()  # each verdict depends on those before it: tests hold it against a model that keeps raw texts
def memory_guard(t):
    return guard.replay(*stories(t), PARTS, RULES).withColumn("novelty", F.round("novelty", 6))


@query()
def remembered_events(t):
    return guard.remembered(*stories(t), PARTS, RULES)
