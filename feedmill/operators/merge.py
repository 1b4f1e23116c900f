"""Keyed merges: latest wins, blanks filled, rolling windows, snapshot changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """One row of each key, that with the greatest time; at a tie the new side's."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc("_side")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_side")


def fold_by_recency(rows: DataFrame, key: str, at: str, fields: Sequence[str], earliest: Sequence[str] = ()) -> DataFrame:
    """One row of each key: every field from the newest row that has it (null and '' count as blank), the least of the earliest ones."""
    filled = lambda c: F.nullif(F.col(c), F.lit("")) if dict(rows.dtypes)[c] == "string" else F.col(c)
    newest = [F.max_by(filled(c), F.when(filled(c).isNotNull(), F.col(at))).alias(c) for c in fields]
    return rows.groupBy(key).agg(F.max(at).alias(at), *newest, *(F.min(c).alias(c) for c in earliest))


def fill_by_precedence(today: DataFrame, history: DataFrame, key: str, sticky: Sequence[str]) -> DataFrame:
    """Full outer by key: today's row wins, but what it lacks of the sticky columns comes from history; fetched_today tells the side."""
    t, h = today.alias("t"), history.alias("h")
    names = [c for c in today.columns if c != key]
    fresh = F.col(f"t.{key}").isNotNull()
    out = t.join(h, F.col(f"t.{key}") == F.col(f"h.{key}"), "full_outer")
    pick = [F.coalesce(f"t.{c}", f"h.{c}").alias(c) if c in sticky else F.when(fresh, F.col(f"t.{c}")).otherwise(F.col(f"h.{c}")).alias(c) for c in names]
    return out.select(F.coalesce(f"t.{key}", f"h.{key}").alias(key), *pick, fresh.alias("fetched_today"))


def fill_missing(rows: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """rows with a blank column taken from another table's row of the key; of several the least value that is not blank."""
    side = other.groupBy(key).agg(F.min(F.when(F.coalesce(F.trim(F.col(column)), F.lit("")) != "", F.col(column))).alias("_other"))
    value = F.when(F.coalesce(F.trim(F.col(column)), F.lit("")) == "", F.col("_other")).otherwise(F.col(column))
    return rows.join(side, key, "left").withColumn(column, value).drop("_other")


def online_first(online: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """All online rows and the local ones of other keys."""
    return online.unionByName(local.join(online, key, "left_anti"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, type (added, removed, changed), field, from, to: one row for each new or lost key and each changed field, compared as text."""
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"), "full_outer")
    was, now = F.col(f"b.{key}").isNotNull(), F.col(f"a.{key}").isNotNull()
    changes = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("from"), F.col(f"a.{f}").cast("string").alias("to")) for f in fields))
    changed = F.filter(changes, lambda x: ~x["from"].eqNullSafe(x["to"]))
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to")))
    kind = F.when(was & now, "changed").when(now, "added").otherwise("removed")
    rows = both.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), kind.alias("type"), F.explode(F.when(was & now, changed).otherwise(none)).alias("x"))
    return rows.select(key, "type", "x.field", "x.from", "x.to")


def priority_union(frames: Sequence[DataFrame], key: str, order: Sequence[Column | str]) -> DataFrame:
    """Union of frames in which the earlier frame's row of a key wins, then the given order."""
    out = None
    for rank, frame in enumerate(frames):
        part = frame.withColumn("_frame", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    place = F.row_number().over(Window.partitionBy(key).orderBy("_frame", *order))
    return out.withColumn("_place", place).where("_place = 1").drop("_place", "_frame")


def replace_partition(stored: DataFrame, fresh: DataFrame, column: str) -> DataFrame:
    """stored with the fresh values' partitions replaced whole."""
    return stored.join(fresh.select(column).distinct(), column, "left_anti").unionByName(fresh)


def union_arrays(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Full outer by key with the sorted union of two array columns."""
    right = b.select(key, F.col(column).alias("_b"))
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce(column, F.array().cast("array<string>")), F.coalesce("_b", F.array().cast("array<string>")))))
    return a.select(key, column).join(right, key, "full_outer").select(key, both.alias(column))
