"""Writers: dated documents, append-only logs, ledgers replaced by versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.sources import manifest


def append_log(rows: DataFrame, path: str, day: str | None = None) -> None:
    """Appends JSON lines, in a partition of each day if a time column is named."""
    if day:
        rows = rows.withColumn("date", F.to_date(day))
        rows.write.mode("append").partitionBy("date").json(path)
    else:
        rows.write.mode("append").json(path)


def dated_snapshot(rows: DataFrame, path: str, day: str = "date") -> None:
    """Replaces the partitions of the days that rows hold, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """A new version of a table in place of all its rows, which rows may have been read from; readers see the old one or the new one, at every moment (see manifest)."""
    manifest.write(rows, path, overwrite=True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that replace() writes."""
    return manifest.read(spark, path)


def with_field(documents: DataFrame, column: str, field: str, value) -> DataFrame:
    """documents with one field of a nested document set; the others stay."""
    return documents.withColumn(column, F.col(column).withField(field, value))


def drop_old(rows: DataFrame, day: str, keep: int) -> DataFrame:
    """rows of the latest `keep` days that occur."""
    latest = rows.select(day).distinct().orderBy(F.desc(day)).limit(keep)
    return rows.join(latest, day, "left_semi")


def markdown(rows: DataFrame, section: str, rank: str, title: str, url: str) -> DataFrame:
    """section, markdown: a heading and a linked line for each row in order of rank."""
    line = F.concat(F.lit("- ["), F.col(title), F.lit("]("), F.col(url), F.lit(")"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l")))), lambda x: x["l"]), "\n")  # a section's display quota bounds it
    return rows.groupBy(section).agg(lines.alias("lines")).select(section, F.concat(F.lit("## "), F.col(section), F.lit("\n"), F.col("lines")).alias("markdown"))
