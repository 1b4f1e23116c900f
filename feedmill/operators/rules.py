"""Data-quality rules: each gives rows (rule, level, key, detail) of what breaks it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmill.functions import lexicon
from feedmill.operators.dedupe import similar_pairs


def _issues(rows: DataFrame, rule: str, level: str, key: Column | str, detail: Column) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return rows.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def foreign_key(rows: DataFrame, column: str, pool: DataFrame, pool_column: str, key: str, rule: str = "foreign key", level: str = "block") -> DataFrame:
    """Rows whose value no row of the pool has."""
    return _issues(rows.join(pool.select(F.col(pool_column).alias(column)).distinct(), column, "left_anti"), rule, level, key, F.col(column))


def vocabulary(rows: DataFrame, column: str, allowed: Sequence[str], key: str, rule: str = "vocabulary", level: str = "warn") -> DataFrame:
    """Rows with a value, or an element of an array, outside a closed list."""
    values = F.explode(column) if dict(rows.dtypes)[column].startswith("array") else F.col(column)
    flat = rows.select(F.col(key).alias("_key"), values.alias("_value"))
    return _issues(flat.where(~F.col("_value").isin(*allowed)), rule, level, "_key", F.col("_value"))


def evidence(rows: DataFrame, quote: str, source: str, key: str, rule: str = "evidence", level: str = "block") -> DataFrame:
    """Rows whose quote does not stand in their source text."""
    return _issues(rows.where(~F.coalesce(F.contains(F.col(source), F.col(quote)), F.lit(False))), rule, level, key, F.col(quote))


def pattern(rows: DataFrame, column: str, words: Sequence[str], key: str, rule: str = "wording", level: str = "warn") -> DataFrame:
    """Rows with one of the words."""
    return _issues(rows.where(lexicon.hits(F.col(column), words)), rule, level, key, F.lit(column))


def unsupported_numbers(rows: DataFrame, text: str, source: str, key: str, rule: str = "numbers", level: str = "block") -> DataFrame:
    """Rows with a number of two digits or more that their source lacks."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"(\d{2,})"), F.lit(1)))
    missing = F.array_except(numbers(text), numbers(source))
    return _issues(rows.withColumn("_missing", missing).where(F.size("_missing") > 0), rule, level, key, F.array_join("_missing", ","))


def length_between(rows: DataFrame, column: str, low: int, high: int, key: str, rule: str = "length", level: str = "warn") -> DataFrame:
    """Rows whose text has fewer or more characters than allowed; null counts as none."""
    n = F.length(F.coalesce(F.col(column), F.lit("")))
    return _issues(rows.where((n < low) | (n > high)), rule, level, key, n)


def at_most(rows: DataFrame, group: Sequence[str], fits: Column, most: int, rule: str = "quota", level: str = "warn") -> DataFrame:
    """Groups with more fitting rows than allowed; no group columns: the whole table."""
    counted = rows.where(fits).groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return _issues(counted, rule, level, F.concat_ws("/", *group) if group else F.lit("all"), F.col("_n"))


def unique(rows: DataFrame, columns: Sequence[str], rule: str = "unique", level: str = "block") -> DataFrame:
    """Keys that stand more than once."""
    return _issues(rows.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1"), rule, level, F.concat_ws("/", *columns), F.col("_n"))


def alike(rows: DataFrame, grams: Column, key: str, threshold: float = 0.8, rule: str = "alike", level: str = "warn") -> DataFrame:
    """Pairs of rows whose piece sets are alike by more than the threshold."""
    sets = rows.select(F.col(key).alias("id"), grams.alias("grams")).where(F.size("grams") > 0)
    found = similar_pairs(sets, None, threshold).where(F.col("score") > threshold)
    return _issues(found, rule, level, "u", F.col("v"))


def stale(rows: DataFrame, group: Sequence[str], day: str, today: Column, most: int, rule: str = "stale", level: str = "warn") -> DataFrame:
    """Groups whose newest day lies more than `most` days back."""
    lag = F.datediff(today, F.max(day))
    return _issues(rows.groupBy(*group).agg(lag.alias("_lag")).where(F.col("_lag") > most), rule, level, F.concat_ws("/", *group), F.col("_lag"))


def all_of(*issues: DataFrame) -> DataFrame:
    """All issues in one table."""
    out = issues[0]
    for more in issues[1:]:
        out = out.unionByName(more)
    return out


def drop_blocked(rows: DataFrame, key: str, issues: DataFrame) -> DataFrame:
    """rows without those that a blocking issue names."""
    blocked = issues.where("level = 'block'").select(F.col("key").alias("_key")).distinct()
    return rows.join(blocked, F.col(key).cast("string") == F.col("_key"), "left_anti")


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def purity(rows: DataFrame, section: Column, locale: str, home: str, words: Sequence[str], text: Column, key: str, rule: str = "purity") -> DataFrame:
    """Rows of a section of a place: blocked if their locale is another or null, warned of if their text names none of its words."""
    own = rows.where(F.coalesce(section, F.lit(False)))
    away = ~F.coalesce(F.col(locale) == home, F.lit(False))
    level = F.when(away, "block").when(~lexicon.hits(F.coalesce(text, F.lit("")), words), "warn")
    found = own.select(F.lit(rule).alias("rule"), level.alias("level"), F.col(key).cast("string").alias("key"), F.when(away, F.col(locale)).cast("string").alias("detail"))
    return found.where("level is not null")


def untranslated(rows: DataFrame, column: str, key: str, letters: int = 3, most: int = 4, rule: str = "untranslated", level: str = "warn") -> DataFrame:
    """Rows of `most` or more runs of so many Latin letters."""
    runs = F.size(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(f"[A-Za-z]{{{letters},}}"), F.lit(0)))
    return _issues(rows.where(runs >= most), rule, level, key, runs)


def time_wording(rows: DataFrame, text: str, when: str, key: str, today: str = "今天", words: Sequence[str] = ("今天", "今日"), rule: str = "time wording", level: str = "warn") -> DataFrame:
    """Rows whose text speaks of today though their own day, where it is stated, doesn't begin with today's name."""
    other = F.coalesce(~F.col(when).startswith(today) & (F.col(when) != ""), F.lit(False))
    said = F.lit(False)
    for word in words:
        said = said | F.coalesce(F.contains(F.col(text), F.lit(word)), F.lit(False))
    return _issues(rows.where(other & said), rule, level, key, F.col(when))
