"""From source rows to articles that have a publish time, a tier and an excerpt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmill.functions import dates, urls


def normalize(rows: DataFrame, sources: DataFrame | None = None, title_cut: int = 90) -> DataFrame:
    """Rows with a publish time only (never the fetch time instead); excerpt falls back to the title's start; tier and display name by source_id."""
    out = rows.where(F.col("published_at").isNotNull())
    excerpt = F.coalesce(F.nullif(F.trim("excerpt"), F.lit("")), F.substring("title", 1, title_cut), F.lit(""))
    out = out.withColumn("excerpt", excerpt)
    if sources is None:
        return out
    dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), F.col("tier").alias("source_tier"))
    out = out.join(dim, "source_id", "left").withColumn("source", F.coalesce("source", "source_id"))
    return out.withColumn("tier", F.coalesce("tier", "source_tier")).drop("source_tier") if "tier" in rows.columns else out.withColumnRenamed("source_tier", "tier")


def from_crawl(rows: DataFrame, offset: str = "+08:00") -> DataFrame:
    """Crawled all-text rows: publish time from its own field, else from the link's digits."""
    day = F.to_timestamp(F.concat(F.date_format(urls.date_from_url(F.col("url")), "yyyy-MM-dd"), F.lit(f"T00:00:00{offset}")))
    return rows.withColumn("published_at", F.coalesce(dates.normal_published(F.col("published_at"), offset), day))


def route_prefix(source_id: Column, old: str, new: str) -> Column:
    """source_id with its prefix exchanged; one that has the new prefix already stays."""
    return F.when(source_id.startswith(f"{new}-"), source_id).otherwise(F.regexp_replace(source_id, f"^{old}-", f"{new}-"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column | str], keep_empty: bool = False) -> DataFrame:
    """First row of each key. keep_empty: rows whose keys are all null or empty stay, else they are one key like any other."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = rows.withColumn("_rank", rank)
    if keep_empty:
        blank = F.lit(True)
        for key in keys:
            blank = blank & (F.coalesce(F.col(key).cast("string"), F.lit("")) == "")
        return out.where((F.col("_rank") == 1) | blank).drop("_rank")
    return out.where("_rank = 1").drop("_rank")


def in_window(rows: DataFrame, at: str, today: Column, days: int, exempt: Column | None = None, exempt_days: int | None = None) -> DataFrame:
    """Rows of the last `days` calendar days; exempt rows of the last exempt_days."""
    keep = dates.within_calendar_days(F.col(at), today, days)
    if exempt is not None:
        keep = F.when(exempt, dates.within_calendar_days(F.col(at), today, exempt_days or days)).otherwise(keep)
    return rows.where(keep)


def counted(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """rows with `dropped_by`: the first gate that a row fails, null if it passes all; counting by it gives every gate's loss."""
    gate = F.lit(None).cast("string")
    for name, passes in reversed(gates.items()):
        gate = F.when(~F.coalesce(passes, F.lit(False)), name).otherwise(gate)
    return rows.withColumn("dropped_by", gate)
