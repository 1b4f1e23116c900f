"""Calendar days as Columns. Each rule for a day's distance has its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPORT_ZONE = "Asia/Shanghai"


def date_key(at: Column, zone: str = REPORT_ZONE) -> Column:
    """Calendar day of a UTC time in the report's zone."""
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), zone))


def within_calendar_days(at: Column, today: Column, days: int, zone: str = REPORT_ZONE) -> Column:
    """Whether a UTC time falls on one of the last `days` calendar days, today included; the future and null don't."""
    gap = F.datediff(today, date_key(at, zone))
    return F.coalesce((gap >= 0) & (gap < days), F.lit(False))


def within_gap(day: Column, today: Column, most: int) -> Column:
    """Whether a day lies 0 to `most` days back, that is most + 1 calendar days."""
    gap = F.datediff(today, day)
    return F.coalesce((gap >= 0) & (gap <= most), F.lit(False))


def signed_gap(a: Column, b: Column) -> Column:
    """Days from a to b; 0 if either is no date."""
    return F.coalesce(F.datediff(b, a), F.lit(0))


def clamped_gap(a: Column, b: Column) -> Column:
    """Days from a to b, never below 0; 0 if either is no date."""
    return F.greatest(signed_gap(a, b), F.lit(0))


def previous_day(day: Column, days: int = 1) -> Column:
    return F.date_sub(day, days)


def recent_mmdd(today: Column, days: int) -> Column:
    """MM/DD of the last `days` days, today first."""
    return F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_format(F.date_sub(today, i), "MM/dd"))


def weekday(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def is_weekend_edition(day: Column) -> Column:
    """Saturday, Sunday or Monday: editions that cover a weekend."""
    return weekday(day).isin(6, 0, 1)


def previous_trading_day(day: Column) -> Column:
    """The weekday before, without holidays."""
    return F.date_sub(day, F.when(weekday(day) == 1, 3).when(weekday(day) == 0, 2).otherwise(1))


def relative_day(day: Column, today: Column) -> Column:
    """today, yesterday, two days ago, else MM/DD; null for null."""
    gap = F.datediff(today, day)
    return F.when(gap == 0, "today").when(gap == 1, "yesterday").when(gap == 2, "two days ago").when(day.isNotNull(), F.date_format(day, "MM/dd"))


def is_date_only(at: Column, zone: str = REPORT_ZONE) -> Column:
    """Midnight in UTC or in the report's zone: a time that only names a day."""
    midnight = lambda t: F.date_format(t, "HH:mm:ss") == "00:00:00"
    stamp = at.cast("timestamp")
    return F.coalesce(midnight(stamp) | midnight(F.from_utc_timestamp(stamp, zone)), F.lit(False))


def normal_published(text: Column, offset: str = "+08:00") -> Column:
    """A time text as a timestamp: one without an offset gets the report's; what is no time is null."""
    t = F.replace(F.trim(text), F.lit(" "), F.lit("T"))
    naive = t.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"), F.concat(t, F.lit(":00"))).otherwise(t)
    return F.try_to_timestamp(F.when(naive, F.concat(full, F.lit(offset))).otherwise(t))


def age_factor(at: Column, now: Column, exempt: Column | None = None) -> Column:
    """1.0 up to a day old, 0.9 up to two, 0.8 beyond; the future, unknown times and exempt rows 1.0."""
    hours = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / 3600
    out = F.when(hours <= 24, 1.0).when(hours <= 48, 0.9).otherwise(0.8)
    out = F.when(hours.isNull(), F.lit(1.0)).otherwise(out)
    return out if exempt is None else F.when(exempt, F.lit(1.0)).otherwise(out)
