"""Memory of what was shown: history of links, events with cooldown and novelty, as batch folds of keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmill.functions import dates


def is_fresh(published: Column, last_seen: Column, today: Column, days: int = 2, zone: str = dates.REPORT_ZONE) -> Column:
    """Published on one of the last days; what is dated in the future counts by when it was last seen; no publish time is never fresh."""
    future = dates.date_key(published, zone) > today
    return F.coalesce(F.when(future, dates.within_calendar_days(last_seen, today, days, zone)).otherwise(dates.within_calendar_days(published, today, days, zone)), F.lit(False))


def upsert_history(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """One row of each url: title and publish time of the latest sight, first_seen kept, summary and relevance sticky.

    Both tables have (url, title, published_at, summary, relevant, seen_at).
    """
    rows = stored.unionByName(seen)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seen_at"))).alias(c)
    return rows.groupBy("url").agg(F.max_by("title", "seen_at").alias("title"), F.max_by("published_at", "seen_at").alias("published_at"), known("summary"), known("relevant"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def novelty(new_facts: Column, facts: Column, new_grams: Column, grams: Column, stage_changed: Column, new_period: Column) -> Column:
    """0.45 share of new facts + 0.35 share of new title pieces + 0.2 for another stage + 0.2 for another period, at most 1."""
    share = lambda a, b: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_except(a, b)) / F.greatest(F.size(a), F.lit(1)))
    return F.least(F.lit(1.0), 0.45 * share(new_facts, facts) + 0.35 * share(new_grams, grams) + F.when(stage_changed, 0.2).otherwise(0.0) + F.when(new_period, 0.2).otherwise(0.0))


def cooldown_days(base: Column, count: Column, scale: float = 1.0, most: int = 14) -> Column:
    """base x scale x (1 + 0.5 (count - 1)) days, rounded half up, at most `most`."""
    return F.least(F.floor(base * scale * (1 + 0.5 * (count - 1)) + 0.5), F.lit(most))


def decayed_threshold(threshold: Column, age: Column, floor: float = 0.25, days: int = 14) -> Column:
    """A threshold that falls with age in a straight line to the floor over `days`."""
    return F.greatest(F.lit(floor), threshold - (threshold - floor) * F.least(F.lit(1.0), age / days))


def verdict(matched: Column, age: Column, cooldown: Column, novel: Column, threshold: Column, count: Column, most: int = 6) -> Column:
    """new, exhausted, progress, refresh, cooldown or duplicate for a candidate against the event that it matches."""
    return F.when(~matched, "new").when(count >= most, "exhausted").when(novel >= threshold, F.when(age >= cooldown, "refresh").otherwise("progress")).when(age < cooldown, "cooldown").otherwise("duplicate")


def prune(events: DataFrame, today: Column, last: str, peak: str, key: str, days: int = 45, peak_days: int = 90, peak_score: float = 60, most: int = 400) -> DataFrame:
    """Events last shown within `days` (peak_days for those that once scored high), the newest `most` of them."""
    age = F.datediff(today, last)
    fresh = events.where(age <= F.when(F.col(peak) >= peak_score, peak_days).otherwise(days))
    return fresh.orderBy(F.desc(last), key).limit(most)


def delta(previous_date: Column, progress: Column, stage_changed: Column) -> Column:
    """new, changed or followup against the last issue that had the event."""
    return F.when(previous_date.isNull(), "new").when((progress >= 0.35) | stage_changed, "changed").otherwise("followup")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in doubles as IEEE has it, where Spark raises an error: a zero divides to an infinity of part's sign, and zero to NaN, which is above all numbers."""
    return F.when(whole == 0, part * F.pow(whole.cast("double"), F.lit(-1.0))).otherwise(part / F.nullif(whole, F.lit(0).cast("double")))


def filter_samples(events: DataFrame, column: str, low: Column, high: Column, keep_unknown: bool = True) -> DataFrame:
    """events with the nested samples of a time range (bounds included, null bounds open); events left without any go."""

    def fits(x: Column) -> Column:
        at = x["at"]
        return F.coalesce((low.isNull() | (at >= low)) & (high.isNull() | (at <= high)), F.lit(keep_unknown))

    return events.withColumn(column, F.filter(column, fits)).where(F.size(column) > 0)


def shown_often(days: Column, today: Column, window: int = 7, most: int = 2) -> Column:
    """Whether an array of days holds `most` or more of the last `window` days."""
    return F.size(F.filter(days, lambda d: (F.datediff(today, d) >= 0) & (F.datediff(today, d) < window))) >= most


def settle(staged: DataFrame, delivered: DataFrame) -> DataFrame:
    """Staged rows (day, ...) with status delivered, mismatch (other fingerprint) or no-delivery by the deliveries (day, sha)."""
    own = delivered.select("day", F.col("sha").alias("_sha"))
    status = F.when(F.col("_sha").isNull(), "no-delivery").when(F.col("_sha") == F.col("sha"), "delivered").otherwise("mismatch")
    return staged.join(own, "day", "left").withColumn("status", status).drop("_sha")


def streaks(rows: DataFrame, key: str, day: str) -> DataFrame:
    """key, streak_start, days: the runs of consecutive days on which each key was seen."""
    each = rows.select(key, day).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy(day))
    return each.withColumn("_run", F.date_sub(F.col(day), place)).groupBy(key, "_run").agg(F.min(day).alias("streak_start"), F.count("*").alias("days")).drop("_run")


def brief(records: DataFrame, today: Column, group: str, order: list[str], angles: Column, used: str, lookback: int = 10, most: int = 8) -> DataFrame:
    """Of each group the `most` events told last within `lookback` days before today: records (last_day, ...) with age, and angle, the first of `angles` not in the array `used`, or its first one if all are."""
    age = F.datediff(today, "last_day")
    fresh = records.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") <= lookback))
    left = F.get(F.array_except(angles, F.coalesce(F.col(used), F.array().cast("array<string>"))), F.lit(0))
    place = F.row_number().over(Window.partitionBy(group).orderBy("age", *order))
    out = fresh.withColumn("angle", F.coalesce(left, F.get(F.col(used), F.lit(0)))).withColumn("_place", place)
    return out.where(F.col("_place") <= most).drop("_place")
