"""Leads with what has changed on them, as a panel and a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions import filings

# Kinds of report, the better first, and the market of a lead that states none.
REPORT_KINDS = ("manual", "deep")
HOME_MARKET = "hk"


def changed(changes: DataFrame) -> DataFrame:
    """lead_id, changed_at, is_new, changed_fields (sorted) of changes (lead_id, at, type, field); rows without an id are left out."""
    field = F.when(F.col("type") == "changed", F.nullif(F.col("field"), F.lit("")))
    known = changes.where(F.coalesce(F.col("lead_id"), F.lit("")) != "")
    return known.groupBy("lead_id").agg(F.max("at").alias("changed_at"), F.coalesce(F.bool_or(F.col("type") == "added"), F.lit(False)).alias("is_new"), F.sort_array(F.collect_set(field)).alias("changed_fields"))


def best_report(reports: DataFrame) -> DataFrame:
    """lead_id, url, kind of the best report of each lead that has a manual or a deep one; at a tie the least url."""
    rank = F.array_position(F.array(*map(F.lit, REPORT_KINDS)), F.col("kind"))
    return reports.where(rank > 0).groupBy("lead_id").agg(F.min_by(F.struct("url", "kind"), F.struct(rank, "url")).alias("best")).select("lead_id", "best.*")


def _recent(today: Column, days: int) -> Column:
    submitted = F.col("submitted")
    return filings.in_any_window(filings.window_days(submitted, F.to_date("found_at"), F.to_date("changed_at")), today, days)


def _active() -> Column:
    return F.coalesce(F.to_date("changed_at"), F.col("submitted"))


def with_changes(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """leads (lead_id, label, submitted, found_at, market and others) with the columns of `changed`; a null market is the home one."""
    out = leads.join(changed(changes), "lead_id", "left")
    return out.withColumn("is_new", F.coalesce("is_new", F.lit(False))).withColumn("changed_fields", F.coalesce("changed_fields", F.array().cast("array<string>"))).withColumn("market", F.coalesce("market", F.lit(HOME_MARKET)))


def panel(leads: DataFrame, reports: DataFrame, matched: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Leads with a label and a day in the window, with report_url (a page of their own where no report is better), matched and `active`, the day to sort by."""
    hits = matched.select("lead_id").distinct().withColumn("matched", F.lit(True))
    out = leads.where((F.coalesce(F.col("label"), F.lit("")) != "") & _recent(today, days))
    out = out.join(best_report(reports).select("lead_id", F.col("url").alias("report_url")), "lead_id", "left").join(hits, "lead_id", "left")
    own = F.concat(F.lit("../redchip/r/"), F.col("lead_id"), F.lit(".html"))
    return out.withColumns({"report_url": F.coalesce("report_url", own), "matched": F.coalesce("matched", F.lit(False)), "active": _active()})


def adjacent(leads: DataFrame, today: Column, days: int = 7, n: int = 20) -> DataFrame:
    """The n latest leads without a label that are connected to the region and recent."""
    rows = leads.where((F.coalesce(F.col("label"), F.lit("")) == "") & F.col("connected") & _recent(today, days))
    return rows.withColumn("active", _active()).orderBy(F.desc_nulls_last("active"), "lead_id").limit(n)


def ledger(leads: DataFrame) -> DataFrame:
    """market, leads (with a label), last_at: the latest time of a change or a find among all leads of the market."""
    labelled = F.count(F.when(F.coalesce(F.col("label"), F.lit("")) != "", 1))
    return leads.groupBy("market").agg(labelled.alias("leads"), F.max(F.greatest("changed_at", "found_at")).alias("last_at"))
