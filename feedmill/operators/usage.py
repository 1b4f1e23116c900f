"""Counts of calls, sources, facets and yields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_group(calls: DataFrame, group: Sequence[str], ok: Column, duration: str, error: str | None = None) -> DataFrame:
    """calls, failures, mean duration (rounded half up) of each group, unknown where a group column is null; error kinds as a map."""
    named = calls.select(*(F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias(g) for g in group), ok.alias("_ok"), F.col(duration).alias("_ms"), (F.col(error) if error else F.lit(None).cast("string")).alias("_error"))
    counted = named.groupBy(*group).agg(F.count("*").alias("calls"), F.sum((~F.col("_ok")).cast("long")).alias("failures"), F.floor(F.avg("_ms") + 0.5).alias("avg_ms"))
    if not error:
        return counted
    kinds = named.where("not _ok and _error is not null").groupBy(*group, "_error").agg(F.count("*").alias("n")).groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_error", "n")))).alias("errors"))
    return counted.join(kinds, list(group), "left")


def rollup(calls: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """n and total of every prefix of the group columns; a subtotal has null in the rest and says so in `level`."""
    return calls.rollup(*group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.grouping_id().alias("level"))


def facets(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """facet, value, n for each column by itself, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def source_yield(inflow: DataFrame, kept: DataFrame, source: str, score: str, registry: DataFrame | None = None) -> DataFrame:
    """inflow, kept, ratio and mean score of each source; registered sources without any row count 0."""
    came = inflow.groupBy(source).agg(F.count("*").alias("inflow"))
    stay = kept.groupBy(source).agg(F.count("*").alias("kept"), F.avg(score).alias("avg_score"))
    out = came.join(stay, source, "full_outer")
    if registry is not None:
        out = registry.select(source).distinct().join(out, source, "full_outer")
    out = out.withColumn("inflow", F.coalesce("inflow", F.lit(0))).withColumn("kept", F.coalesce("kept", F.lit(0)))
    return out.withColumn("ratio", F.when(F.col("inflow") > 0, F.col("kept") / F.col("inflow")).otherwise(0.0))


def classify_error(text: Column) -> Column:
    """timeout, quota, auth or other by an error's text; null stays null."""
    t = F.lower(text)
    return F.when(t.rlike("timeout|timed out|etimedout"), "timeout").when(t.rlike(r"quota|rate limit|\b429\b"), "quota").when(t.rlike(r"\b401\b|\b403\b|unauthori|forbidden|api key"), "auth").when(t.isNotNull(), "other")


def tag_counts(rows: DataFrame, tags: str) -> DataFrame:
    """tag, n over all rows, most frequent first."""
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def coverage(rows: DataFrame, key: str, lines: Column, names: Sequence[str], examples: int = 2) -> DataFrame:
    """line, n, examples of every named line, those without a row too: how many rows have it, and the first keys among them."""
    each = rows.select(F.col(key).alias("_key"), F.explode(F.array_distinct(lines)).alias("line"))
    place = F.row_number().over(Window.partitionBy("line").orderBy("_key"))
    first = each.withColumn("_place", place).where(F.col("_place") <= examples).groupBy("line").agg(F.array_sort(F.collect_list("_key")).alias("examples"))  # `examples` keys
    counted = each.groupBy("line").agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(n,) for n in names], "line string")
    return every.join(counted, "line", "left").join(first, "line", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def in_order(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """rows with their `place` in a group: what a list of each group would hold, without one."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def latest_at(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The latest of all times in several columns, nulls aside: one row."""
    return rows.agg(F.greatest(*(F.max(c) for c in columns)).alias("latest") if len(columns) > 1 else F.max(columns[0]).alias("latest"))
