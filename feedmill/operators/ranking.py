"""Quotas, caps, floors and tiers as window ranks. Every order ends in a unique column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column | str]


def top_per_group(rows: DataFrame, group: Sequence[str], order: Order, n: int) -> DataFrame:
    """First n rows of each group; Spark cuts each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def interleaved_quota(rows: DataFrame, source: str, order: Order, per_source: int = 20, top: int = 200) -> DataFrame:
    """Best rows while each source has at most per_source, until there are `top`: a source's quota does not depend on where the whole stops."""
    return top_per_group(rows, [source], order, per_source).orderBy(*order).limit(top)


def top_then_quota(rows: DataFrame, source: str, order: Order, top: int = 60, per_source: int = 8) -> DataFrame:
    """The best `top` rows first, and of those at most per_source of each source."""
    return top_per_group(rows.orderBy(*order).limit(top), [source], order, per_source)


def cap_subset(rows: DataFrame, source: str, subset: Column, order: Order, per_source: int) -> DataFrame:
    """At most per_source rows of each source of the subset; all others stay."""
    capped = top_per_group(rows.where(subset), [source], order, per_source)
    return rows.where(~F.coalesce(subset, F.lit(False))).unionByName(capped)


def section_ranks(rows: DataFrame, section: str, source: str, order: Order, per_source: int = 4, per_section: int = 18) -> DataFrame:
    """At most per_source rows of a source in a section and per_section in all, with their rank there."""
    within = top_per_group(rows, [section, source], order, per_source)
    rank = F.row_number().over(Window.partitionBy(section).orderBy(*order))
    return within.withColumn("rank", rank).where(F.col("rank") <= per_section)


def cap_with_exemption(rows: DataFrame, source: str, score: str, order: Order, cap: int, exempt_score: float = 60, extra: int = 4) -> DataFrame:
    """Top `cap` of each source; beyond, rows of exempt_score or more, at most `extra` of a source."""
    spot = Window.partitionBy(source).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(spot))
    late = ranked.withColumn("_late", (F.col("_rank") > cap) & (F.col(score) >= exempt_score))
    nth = F.sum(F.col("_late").cast("int")).over(spot.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return late.withColumn("_nth", nth).where((F.col("_rank") <= cap) | (F.col("_late") & (F.col("_nth") <= extra))).drop("_rank", "_late", "_nth")


def display_caps(rows: DataFrame, section: str, source: str, value: Order, score: str, rank: Order, caps: Mapping[str, tuple[int, int]], exempt: float = 60, extra: int = 4) -> DataFrame:
    """rows that sections show. caps: for each section rows of a source and of all; other sections show all theirs.

    Of a source the best by value stay, of these the first by rank up to the section's cap; then rows beyond their source's
    cap with a score of `exempt` or more fill in, best first, until the section is `extra` over its cap. Each step
    is a window limit, so a hot source sends no more than its cap.
    """
    capped = F.create_map(*(F.lit(x) for name, (each, whole) in caps.items() for x in (name, F.struct(F.lit(each).alias("each"), F.lit(whole).alias("whole")))))
    marked = rows.withColumn("_cap", F.try_element_at(capped, F.col(section)))
    most, total = max(each for each, _ in caps.values()), max(whole for _, whole in caps.values())
    free, own = marked.where("_cap is null").select(*rows.columns), marked.where("_cap is not null")
    best = own.withColumn("_nth", F.row_number().over(Window.partitionBy(section, source).orderBy(*value)))
    base = best.where((F.col("_nth") <= most) & (F.col("_nth") <= F.col("_cap.each")))
    base = base.withColumn("_place", F.row_number().over(Window.partitionBy(section).orderBy(*rank))).where((F.col("_place") <= total) & (F.col("_place") <= F.col("_cap.whole")))
    n = base.groupBy(section).agg(F.count("*").alias("_n"))  # as many rows as there are capped sections
    late = best.where((F.col("_nth") > F.col("_cap.each")) & (F.col(score) >= exempt))
    late = late.withColumn("_late", F.row_number().over(Window.partitionBy(section).orderBy(F.desc(score), *value))).where(F.col("_late") <= total + extra)
    late = late.join(F.broadcast(n), section).where(F.col("_late") <= F.col("_cap.whole") + extra - F.col("_n"))
    return free.unionByName(base.select(*rows.columns)).unionByName(late.select(*rows.columns))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with _copy, the number of a row among those that equal it in all columns, so that every row can be named."""
    return rows.withColumn("_copy", F.row_number().over(Window.partitionBy(*rows.columns).orderBy(F.lit(0))))


def _mark(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Numbered rows with _chosen, whether the few chosen rows name them; nulls equal nulls."""
    names = rows.columns
    few = chosen.select(*(F.col(c).alias(f"_x_{i}") for i, c in enumerate(names)), F.lit(True).alias("_chosen"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_x_{i}")) for i, c in enumerate(names)))
    return rows.join(F.broadcast(few), same, "left").select(*names, F.coalesce("_chosen", F.lit(False)).alias("_chosen"))


def floor_refill(rows: DataFrame, section: str, target: str, fit: Column, order: Order, floor: int = 3) -> DataFrame:
    """Moves the best fitting rows of other sections to the target until it has `floor`; section tells where a row then stands.

    A null section or fit is none of the target's and does not fit; of rows that are equal in all columns as many move as are needed.
    """
    each = _numbered(rows)
    here = rows.where(F.col(section) == target).agg(F.count("*").alias("_here"))
    best = each.where(fit & (F.col(section) != target)).orderBy(*order, "_copy").limit(floor).withColumn("_nth", F.row_number().over(Window.orderBy(*order, "_copy")))
    moved = best.crossJoin(F.broadcast(here)).where(F.col("_nth") <= floor - F.col("_here")).select(*each.columns)  # `floor` rows by one
    return _mark(each, moved).withColumn(section, F.when(F.col("_chosen"), target).otherwise(F.col(section))).select(*rows.columns)


def importance_tiers(rows: DataFrame, group: Sequence[str], order: Order, top: int = 3, tail: float = 0.7) -> DataFrame:
    """importance 3 for the first `top` rows of a group, 1 for the last ceil(tail x size), 2 between; the head wins."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    size = F.count("*").over(Window.partitionBy(*group))
    out = F.when(rank <= top, 3).when(rank > size - F.ceil(size * tail), 1).otherwise(2)
    return rows.withColumn("importance", out)


def limit_level(rows: DataFrame, section: str, order: Order, level: int = 3, per_section: int = 1, overall: int = 3) -> DataFrame:
    """importance of rows of the level lowered by one where a section, or what is left in all, has more than allowed."""
    each = _numbered(rows)
    is_level = F.coalesce(F.col("importance") == level, F.lit(False))
    spot = F.sum(is_level.cast("int")).over(Window.partitionBy(section).orderBy(*order, "_copy").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = each.withColumn("_keep", is_level & (spot <= per_section)).where("_keep").orderBy(*order, "_copy").limit(overall).select(*each.columns)
    lowered = F.when(is_level & ~F.col("_chosen"), level - 1).otherwise(F.col("importance"))
    return _mark(each, first).withColumn("importance", lowered).select(*rows.columns)


def head_and_tail(rows: DataFrame, group: Sequence[str], order: Order, cap: int, head: int = 2) -> DataFrame:
    """Of a longer group the first `head` and the last cap - head rows."""
    window = Window.partitionBy(*group)
    place = F.row_number().over(window.orderBy(*order))
    size = F.count("*").over(window)
    first = min(head, cap)
    return rows.withColumn("_place", place).withColumn("_size", size).where((F.col("_size") <= cap) | (F.col("_place") <= first) | (F.col("_place") > F.col("_size") - (cap - first))).drop("_place", "_size")


def final_ranks(rows: DataFrame, section: str, pinned: Column, order: Order) -> DataFrame:
    """rank in each section: pinned rows first, then by importance, then in the given order."""
    window = Window.partitionBy(section).orderBy(F.desc(pinned.cast("int")), F.desc("importance"), *order)
    return rows.withColumn("rank", F.row_number().over(window))


def next_unused(order: Column, used: Column) -> Column:
    """First of an ordered array that another lacks, null if none is left."""
    return F.get(F.array_except(order, used), F.lit(0))


def take_first_today(rows: DataFrame, today: Column, order: Order, n: int) -> DataFrame:
    """First n rows, today's before others, each in the given order."""
    return rows.orderBy(F.desc(F.coalesce(today, F.lit(False)).cast("int")), *order).limit(n)


def by_tier_and_time(rows: DataFrame, group: Sequence[str], tagged: Column, precision: Column, tier_rank: Column, at: Column, key: str) -> DataFrame:
    """rows with their place in a group: tagged ones first, then by precision of the time, tier (higher first), and time (later first)."""
    window = Window.partitionBy(*group).orderBy(F.desc(tagged.cast("int")), precision, F.desc(tier_rank), F.desc_nulls_last(at), key)
    return rows.withColumn("place", F.row_number().over(window))


def value_score(importance: Column, local: Column, business: Column) -> Column:
    """10 for each level of importance (2 if unknown), 5 for a local row, 3 for a business tag."""
    return F.coalesce(importance, F.lit(2)) * 10 + F.when(local, 5).otherwise(0) + F.when(business, 3).otherwise(0)


def best_per_group(rows: DataFrame, group: Sequence[str], score: Column, order: Order) -> DataFrame:
    """The row of each group with the greatest score, then the first in order."""
    return top_per_group(rows.withColumn("_score", score), group, [F.desc("_score"), *order], 1).drop("_score")


def balanced_pick(rows: DataFrame, kind: str, order: Order, target: int, floor: int = 1) -> DataFrame:
    """`target` rows in order, but the first `floor` of every kind before all others. Spark cuts each kind at `target` before the shuffle."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= target).orderBy(F.desc((F.col("_place") <= floor).cast("int")), *order).limit(target).drop("_place")


def reading_score(importance: Column, tagged: Column, position: Column, bonus: float = 3.0) -> Column:
    """10 or 5 by importance (null counts as 2), a bonus for tagged rows, and a little for the first two positions (from 0)."""
    level = F.coalesce(importance, F.lit(2))
    return F.when(level == 3, 10.0).when(level == 2, 5.0).otherwise(0.0) + F.when(tagged, bonus).otherwise(0.0) + F.when(position == 0, 1.0).when(position == 1, 0.5).otherwise(0.0)


def all_or_quota(rows: DataFrame, source: str, order: Order, n: int, per_source: int = 2) -> DataFrame:
    """All rows if they are n at most, else the n best with at most per_source of each source. No more than n + 1 rows are counted."""
    return rows if rows.limit(n + 1).count() <= n else interleaved_quota(rows, source, order, per_source, n)
