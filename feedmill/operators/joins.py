"""Joins with a range or an order in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched_since(rows: DataFrame, found: DataFrame, key: str, at: str, since: str, group: Sequence[str]) -> DataFrame:
    """group, listed, listed_on: whether a match of the key at or after a row's own time exists, and the latest one's day.

    The matches shrink to the latest of each key before the join: it alone decides.
    """
    latest = found.groupBy(key).agg(F.max(at).alias("_at"))
    hit = F.when(F.col("_at") >= F.col(since), F.col("_at"))
    out = rows.join(latest, key, "left")
    return out.groupBy(*group).agg(F.max(hit).isNotNull().alias("listed"), F.to_date(F.max(hit)).alias("listed_on"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the right row of its key that is latest at or before it; null without one.

    One shuffle by key: both sides in one sorted window, the last right row carried forward.
    """
    cols = [c for c in left.columns if c not in (key, at)]
    l_rows = left.select(key, at, F.lit(1).alias("_side"), F.struct(*cols).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))
    r_rows = right.select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(l_rows.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    window = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = l_rows.unionByName(r_rows).withColumn("_last", F.last("_right", ignorenulls=True).over(window)).where("_side = 1")
    return carried.select(key, at, *(F.col(f"_left.{c}").alias(c) for c in cols), *(F.col(f"_last.{c}").alias(c) for c in values))


def lookup(rows: DataFrame, dimension: DataFrame, key: str, default: Column | None = None, value: str = "value") -> DataFrame:
    """rows with a dimension's value by key, or the default."""
    out = rows.join(dimension.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, default))


def cascade(rows: DataFrame, stages: Sequence[tuple[DataFrame, str]], value: str) -> DataFrame:
    """rows with the value of the first stage (dimension, key) that has their key; of several values of a key the least."""
    out = rows
    names = []
    for i, (dimension, key) in enumerate(stages):
        names.append(f"_v{i}")
        out = out.join(dimension.groupBy(key).agg(F.min(value).alias(names[-1])), key, "left")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)
