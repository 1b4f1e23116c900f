"""Structured Streaming forms of the keyed state that batch folds keep."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = "url string, title string, summary string, relevant boolean, first_seen timestamp, last_seen timestamp, sights long"


def history_upsert(seen: DataFrame, window: str = "2 days") -> DataFrame:
    """Stream of (url, title, summary, relevant, seen_at) to the state of each url after each batch: first_seen kept, summary and relevance sticky.

    seen_at must be a timestamp. A url that the watermark has left behind by the window is dropped from the
    state; if it comes again it is new.
    """
    span = int(pd.Timedelta(window).total_seconds() * 1000)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        title, summary, relevant, first, last, n = state.get if state.exists else (None, None, None, None, None, 0)
        for part in parts:
            for row in part.sort_values("seen_at").itertuples(index=False):
                at = int(row.seen_at.value // 1_000_000)
                newer = last is None or at >= last
                title = row.title if newer else title
                if pd.notna(row.summary) and (newer or summary is None):
                    summary = row.summary
                if pd.notna(row.relevant) and (newer or relevant is None):
                    relevant = bool(row.relevant)
                first, last, n = at if first is None else min(first, at), at if last is None else max(last, at), n + 1
        state.update((title, summary, relevant, first, last, n))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], title, summary, relevant, pd.Timestamp(first, unit="ms"), pd.Timestamp(last, unit="ms"), n)], columns=["url", "title", "summary", "relevant", "first_seen", "last_seen", "sights"])

    rows = seen.select("url", "title", "summary", "relevant", "seen_at").withWatermark("seen_at", window)
    return rows.groupBy("url").applyInPandasWithState(fold, HISTORY, "title string, summary string, relevant boolean, first long, last long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def rolling_usage(calls: DataFrame, at: str, group: str, value: str, window: str = "6 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, group, n, total of sliding windows; calls later than `late` are left out."""
    out = calls.withWatermark(at, late).groupBy(F.window(at, window, slide).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), group, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n of the runs of events with no longer pause than the gap."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_sights(events: DataFrame, keys: list[str], at: str, late: str = "2 days") -> DataFrame:
    """First event of each key within the watermark: a stream's distinct with bounded state."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
