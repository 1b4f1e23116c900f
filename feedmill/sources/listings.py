"""Rows of the exchanges' listing services, out of their JSON answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions import filings

# Where each service keeps its rows, and the fields of code, name, day and area, the first that is filled.
SERVICES: dict[str, tuple[str, dict[str, tuple[str, ...]]]] = {
    "SSE": ("$.pageHelp.data", {"code": ("A_STOCK_CODE",), "name": ("FULL_NAME", "COMPANY_ABBR"), "day": ("LIST_DATE",), "area": ("AREA_NAME_DESC",)}),
    "BSE": ("$[0].listInfo.content", {"code": ("stockCode",), "name": ("companyName", "stockName"), "day": ("issueResultDate", "listDate", "LIST_DATE"), "area": ("registerAddress",)}),
    "SZSE": ("$[0].data", {"code": ("agdm",), "name": ("agjc",), "day": ("agssrq",), "area": ()}),
}


def _day(text: Column) -> Column:
    """A day with dashes or slashes, of eight digits, or of milliseconds in the report's zone."""
    dashed = F.regexp_replace(F.regexp_extract(text, r"(\d{4}[-/]\d{2}[-/]\d{2})", 1), "/", "-")
    stamp = F.when(text.rlike(r"^\d{12,14}$"), filings.day_of_stamp(text.cast("long")))
    return F.coalesce(F.try_to_date(F.nullif(dashed, F.lit("")), "yyyy-MM-dd"), F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")), stamp)


def listings(answers: DataFrame, text: str, service: str, since: Column, area: str | None = None, services: Mapping[str, tuple[str, dict[str, tuple[str, ...]]]] = SERVICES) -> DataFrame:
    """code, name, listed, exchange, area from a column of answers, JSON or JSONP: rows with code, name and a day since then, in the area if the service states one.

    An answer that is null or no JSON gives no rows. Markup in names is dropped.
    """
    path, fields = services[service]
    plain = F.regexp_extract(F.col(text), r"(?s)^\s*(?:[\w$.]+\s*\()?\s*([\[{].*[\]}])", 1)
    names = sorted({f for each in fields.values() for f in each})
    schema = "array<struct<" + ",".join(f"{f}:string" for f in names) + ">>"
    rows = answers.select(F.explode(F.from_json(F.get_json_object(plain, path), schema)).alias("r"))

    def first(candidates: Sequence[str]) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.col(f"r.{c}")), F.lit("")) for c in candidates), F.lit("")) if candidates else F.lit(None).cast("string")

    named = F.trim(F.regexp_replace(first(fields["name"]), "<[^>]+>", ""))
    out = rows.select(first(fields["code"]).alias("code"), named.alias("name"), _day(first(fields["day"])).alias("listed"), F.lit(service).alias("exchange"), first(fields["area"]).alias("area"))
    out = out.where((F.col("code") != "") & (F.col("name") != "") & (F.col("listed") >= since))
    return out.where(F.col("area").rlike(area)) if area and fields["area"] else out
