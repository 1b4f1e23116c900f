"""Samples of what was told, by time of day; and the state of published issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions.dates import REPORT_ZONE


def format_at(at: Column, zone: str = REPORT_ZONE, offset: str = "+08:00") -> Column:
    """A UTC time as local wall time with the zone's offset."""
    return F.concat(F.date_format(F.from_utc_timestamp(at.cast("timestamp"), zone), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def hour(at: Column, zone: str = REPORT_ZONE) -> Column:
    """Hour of the day in the zone, null for null."""
    return F.hour(F.from_utc_timestamp(at.cast("timestamp"), zone))


def in_range(at: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Whether a time lies in a range, bounds included, open where a bound is None or null; a null time does not."""
    out = at.isNotNull()
    if low is not None:
        out &= low.isNull() | (at >= low)
    if high is not None:
        out &= high.isNull() | (at <= high)
    return F.coalesce(out, F.lit(False))


def part_of_day(at: Column, cutoff: int = 9, zone: str = REPORT_ZONE) -> Column:
    """before or after the cutoff hour, unknown without a time."""
    return F.when(at.isNull(), "unknown").when(hour(at, zone) < cutoff, "before").otherwise("after")


def summary(samples: DataFrame, event: str, at: str, cutoff: int = 9, zone: str = REPORT_ZONE) -> DataFrame:
    """part, events, samples of the three parts of the day."""
    return samples.groupBy(part_of_day(F.col(at), cutoff, zone).alias("part")).agg(F.count_distinct(event).alias("events"), F.count("*").alias("samples"))


def listed(samples: DataFrame, at: str, zone: str = REPORT_ZONE) -> DataFrame:
    """samples with `hour`, earliest first, those without a time last."""
    return samples.withColumn("hour", hour(F.col(at), zone)).orderBy(F.asc_nulls_last(at))


def outside(samples: DataFrame, at: str, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """samples outside a range; those without a time stay."""
    return samples.where(F.col(at).isNull() | ~in_range(F.col(at), low, high))


def record_publish(state: DataFrame, entry: DataFrame) -> DataFrame:
    """State of issues (date, source, ...) with the entry's rows in place of those of its dates."""
    return state.join(entry.select("date").distinct(), "date", "left_anti").unionByName(entry)


def is_published(source: Column) -> Column:
    """Whether an issue's entry is final: by schedule, or by hand as final."""
    return F.coalesce(source.isin("schedule", "manual-final"), F.lit(False))


def latest_issues(state: DataFrame, keep: int, date: str = "date") -> DataFrame:
    """Entries of the latest `keep` dates, one at least."""
    dates = state.select(date).distinct().orderBy(F.desc(date)).limit(max(1, keep))
    return state.join(F.broadcast(dates), date, "left_semi")
