"""Picks that lower their demands until there is enough, in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmill.operators.ranking import Order

#: Groups (about 40 bytes each) up to which their stop levels are broadcast.
BROADCAST_GROUPS = 200_000


def first_level(levels: Sequence[Column]) -> Column:
    """Number of the first condition that holds, from 0; null if none does. A null condition doesn't hold."""
    out = F.lit(None).cast("int")
    for number, level in reversed(list(enumerate(levels))):
        out = F.when(F.coalesce(level, F.lit(False)), number).otherwise(out)
    return out


def relaxed(rows: DataFrame, levels: Sequence[Column], group: Sequence[str], order: Order, target: int) -> DataFrame:
    """The first `target` rows of each group by level and order, with `level`: what a loop over the levels takes that stops as soon as it has enough.

    levels: conditions from strict to lax. Rows that no level admits are left out. One shuffle; before it a task keeps no
    more than `target` rows of a group, so a hot group sends few.
    """
    admitted = rows.withColumn("level", first_level(levels)).where("level is not null")
    place = F.row_number().over(Window.partitionBy(*group).orderBy("level", *order))
    return admitted.withColumn("_place", place).where(F.col("_place") <= target).drop("_place")


def relaxed_levels(rows: DataFrame, levels: Sequence[Column], group: Sequence[str], target: int) -> DataFrame:
    """All rows of each group's levels up to the one at which it has `target` rows, with `level`: a loop that adds whole levels while it has too few.

    Counts by group and level are combined before their shuffle; rows themselves move only where the stop levels are too
    many to be broadcast.
    """
    admitted = rows.withColumn("level", first_level(levels)).where("level is not null")
    counts = admitted.groupBy(*group, "level").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    open_levels = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_before") < target)
    stops = open_levels.groupBy(*group).agg(F.max("level").alias("_stop"))
    renamed = stops.select(*[F.col(g).alias(f"_{g}") for g in group], "_stop")
    few = renamed.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    same = F.lit(True)
    for g in group:
        same = same & admitted[g].eqNullSafe(renamed[f"_{g}"])
    return admitted.join(F.broadcast(renamed) if few else renamed, same & (admitted["level"] <= renamed["_stop"])).select(admitted["*"])
