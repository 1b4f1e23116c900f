"""Candidates for a listing, in order of worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions import listings


def score(stage: Column, raised: Column, boost: int = 2) -> Column:
    """Worth of a stage, and a boost for rows that are raised; unknown stages and null are worth nothing."""
    worth = F.lit(0)
    for name, value in listings.WORTH.items():
        worth = F.when(stage == name, value).otherwise(worth)
    return worth + F.when(raised, boost).otherwise(0)


def candidates(rows: DataFrame, stage: str, raised: str, company: str, day: str, order: str, skip: DataFrame | None = None, since: Column | None = None, unique_company: bool = True) -> DataFrame:
    """rows with `score`; of each company the best only, if asked: by score, then the later day, then the lesser `order`.

    Rows before `since` and rows of companies in `skip` (a table with the company column) are left out. A company that
    is null or empty is known by its `order`, which must name a row. The best of a company is found by
    partial aggregation, so a company of any number of rows is no load on one task.
    """
    out = rows.withColumn("score", score(F.col(stage), F.col(raised)))
    if since is not None:
        out = out.where(F.col(day) >= since)
    if skip is not None:
        out = out.join(skip.select(company).distinct(), company, "left_anti")
    if not unique_company:
        return out
    known = F.coalesce(F.nullif(F.trim(company), F.lit("")), F.concat(F.lit("\0"), F.col(order).cast("string")))
    best = F.max_by(F.struct(*out.columns), F.struct("score", day, -F.col(order))).alias("best")
    return out.groupBy(known.alias("known")).agg(best).select("best.*")


def top(rows: DataFrame, day: str, order: str, n: int = 3) -> DataFrame:
    """The n best of scored candidates: by score, then the later day, then the lesser `order`."""
    return rows.orderBy(F.desc("score"), F.desc(day), F.asc(order)).limit(n)
