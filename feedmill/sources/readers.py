"""Readers of feeds, logs and snapshots; every one ends in a DataFrame with a fixed schema."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "source_id string, title string, url string, excerpt string, published_at string, fetched_at string, category string, subcategory string, summary string, tier string"
SOURCE = "id string, name string, type string, url string, category string, subcategory string, enabled boolean, tier string"
CALL = "ts timestamp, backend string, model string, duration_ms long, success boolean, input_chars long, output_chars long, error_category string, error_snippet string"


def json_documents(spark: SparkSession, path: str, schema: str, wrapper: str = "items") -> DataFrame:
    """Rows of JSON files that hold an array, or an object with the array under `wrapper`; files that are neither give none."""
    raw = spark.read.text(path, wholetext=True)
    array = f"array<struct<{_fields(schema)}>>"
    rows = F.coalesce(F.from_json("value", f"struct<{wrapper}:{array}>")[wrapper], F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", array)))
    return raw.select(F.explode(rows).alias("r")).select("r.*")


def _fields(schema: str) -> str:
    """A DDL column list with the colons of a struct."""
    return ", ".join(":".join(part.strip().split(" ", 1)) for part in schema.split(","))


def keyed_map(spark: SparkSession, path: str, schema: str, key: str = "url") -> DataFrame:
    """Rows of JSON files that map a key to an object."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,struct<{_fields(schema)}>>"))).select(F.col("key").alias(key), "value.*")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines; bad ones are skipped, or fail the read if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def dated_lines(spark: SparkSession, path: str, schema: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """JSON lines of files with a date in their names, with `day`; a filter on it is one on the file's name, so other files are not read."""
    rows = spark.read.schema(schema).json(path)
    rows = rows.select("*", F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1)).alias("day"))
    if since:
        rows = rows.where(F.col("day") >= F.to_date(F.lit(since)))
    return rows.where(F.col("day") <= F.to_date(F.lit(until))) if until else rows


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger of JSON lines that is about to be rewritten: a bad line raises, so that nothing is overwritten after a partial read; a missing file is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.cache()
    bad = rows.where("_bad is not null").limit(1).count()
    rows.unpersist()
    if bad:
        raise ValueError(f"{path} has lines that are no JSON")
    return rows.drop("_bad")


def csv_rows(spark: SparkSession, path: str, columns: dict[str, str], key: str) -> DataFrame:
    """CSV with a header, quotes doubled within quotes and line ends in quoted fields: named columns cast, numbers 0 where they are none, rows without a key left out."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    cast = lambda c, kind: F.coalesce(F.expr(f"try_cast(`{c}` as {kind})"), F.lit(0).cast(kind)) if kind in ("int", "long", "double") else F.col(c).cast(kind)
    return raw.select(*(cast(c, kind).alias(c) for c, kind in columns.items())).where(F.coalesce(F.trim(key), F.lit("")) != "")


def rss(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Items of RSS files in the article schema; an item without a date that can be read has a null publish time."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    at = F.coalesce(_rfc822(F.col("pubDate")), F.try_to_timestamp("pubDate"))
    return items.select(F.lit(source_id).alias("source_id"), F.trim("title").alias("title"), F.trim("link").alias("url"), F.trim("description").alias("excerpt"), at.alias("published_at"))


def _rfc822(text: Column) -> Column:
    """A mail-style time without its weekday, which Spark's patterns can't parse."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.try_to_timestamp(F.regexp_replace(bare, r"\s(GMT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))


def jsonp(text: Column) -> Column:
    """The JSON within a callback's parentheses, or the text itself if it is bare."""
    inner = F.regexp_extract(text, r"(?s)^\s*[\w.$]+\s*\((.*)\)\s*;?\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def api_items(responses: DataFrame, column: str, schema: str, most: int = 50) -> DataFrame:
    """First rows of JSON responses that are an array or hold one under items or data; bad JSON gives none."""
    array = f"array<struct<{_fields(schema)}>>"
    body = jsonp(F.col(column))
    rows = F.coalesce(F.from_json(body, f"struct<items:{array}>")["items"], F.from_json(body, f"struct<data:{array}>")["data"], F.when(body.rlike(r"^\s*\["), F.from_json(body, array)))
    return responses.select(*[c for c in responses.columns if c != column], F.explode(F.slice(rows, 1, most)).alias("r")).select("*", "r.*").drop("r")


def anchors(pages: DataFrame, html: str, least: int = 6, most: int = 50) -> DataFrame:
    """Links of pages: (other columns, position, url, title) of anchors whose text has `least` characters, the first `most` of each page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        link = re.compile(r"""<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""", re.I | re.S)
        for pdf in parts:
            rows = []
            for row in pdf.itertuples(index=False):
                n = 0
                for href, inner in link.findall(row[-1] or ""):
                    title = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", inner)).strip()
                    if len(title) >= least and n < most:
                        rows.append((*row[:-1], n, href, title))
                        n += 1
            yield pd.DataFrame(rows, columns=[*pdf.columns[:-1], "position", "url", "title"])

    keep = [c for c in pages.columns if c != html]
    schema = ", ".join(f"`{c}` {dict(pages.dtypes)[c]}" for c in keep)
    return pages.select(*keep, html).mapInPandas(run, f"{schema}, position int, url string, title string")


def table_rows(pages: DataFrame, html: str, least: int = 8) -> DataFrame:
    """Rows of HTML tables with that many cells: (other columns, cells)."""
    tags = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    rows = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    out = pages.withColumn("_row", F.explode(rows)).withColumn("cells", F.transform(F.regexp_extract_all("_row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), tags))
    return out.where(F.size("cells") >= least).drop("_row", html)


def first_root_wins(spark: SparkSession, roots: list[str], schema: str) -> DataFrame:
    """Rows of date=... partitions under several roots; a date comes from the first root that has it."""
    out = None
    for root in roots:
        part = spark.read.schema(f"{schema}, date date").option("basePath", root).json(root)
        out = part if out is None else out.unionByName(part.join(out.select("date").distinct(), "date", "left_anti"))
    return out
