"""Indicators of price series: rows (symbol, d, close), d unique in a symbol."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _series(symbol: str, d: str):
    return Window.partitionBy(symbol).orderBy(d)


def sma(rows: DataFrame, value: str, period: int, symbol: str = "symbol", d: str = "d", name: str = "sma") -> DataFrame:
    """Mean of the last `period` values, full windows only."""
    frame = _series(symbol, d).rowsBetween(-(period - 1), 0)
    return rows.withColumn(name, F.avg(value).over(frame)).withColumn("_n", F.count(value).over(frame)).where(F.col("_n") == period).drop("_n")


def last_ema(values: Column, period: int) -> Column:
    """Exponential mean at the end of an array, from the mean of its first `period` values on; null if it is shorter."""
    seed = F.aggregate(F.slice(values, 1, period), F.lit(0.0), lambda a, x: a + x) / period
    rest = F.slice(values, period + 1, F.greatest(F.size(values) - period, F.lit(0)))
    return F.when(F.size(values) >= period, F.aggregate(rest, seed, lambda a, x: a + (x - a) * (2.0 / (period + 1))))


class Smooth:
    """An exponential mean that goes on from batch to batch: the mean of the first n values, then so much of the way to each next one."""

    def __init__(self, n: int, way: float):
        self.n, self.way, self.seen, self.value = n, way, 0, 0.0

    def push(self, x: np.ndarray) -> np.ndarray:
        """The mean at each of the next values, nan before the n-th; a whole run at once."""
        out, first = np.full(len(x), np.nan), min(max(self.n - self.seen, 0), len(x))
        self.value += x[:first].sum() / self.n
        self.seen += len(x)
        if first and self.seen >= self.n:
            out[first - 1] = self.value
        if first < len(x):
            out[first:] = pd.Series(np.concatenate(([self.value], x[first:]))).ewm(alpha=self.way, adjust=False).mean().to_numpy()[1:]
            self.value = out[-1]
        return out


def _by_run(rows: DataFrame, start: Callable[[], dict], step: Callable[[dict, np.ndarray], dict[str, np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """symbol, d, close and names of the rows where the last of them is known: series come sorted, each as runs of arrays with a state that goes on; a task holds a batch. Rows without a close are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, start()
        for pdf in parts:
            named, close = pdf["symbol"].to_numpy(dtype=object), pdf["close"].to_numpy(dtype=float)
            made = {name: np.full(len(pdf), np.nan) for name in names}
            starts = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1]))) if len(pdf) else []
            for low, high in zip(starts, [*starts[1:], len(pdf)], strict=True):
                if named[low] != symbol:
                    symbol, state = named[low], start()
                for name, values in step(state, close[low:high]).items():
                    made[name][low:high] = values
            out = pdf.assign(**made)
            yield out[out[names[-1]].notna()]

    dealt = rows.select(F.col("symbol").cast("string"), "d", F.col("close").cast("double")).where("close is not null").repartition("symbol").sortWithinPartitions("symbol", "d")
    return dealt.mapInPandas(run, "symbol string, d date, close double" + "".join(f", {name} double" for name in names))


def ema(rows: DataFrame, period: int) -> DataFrame:
    """symbol, d, close, ema of each row with `period` values up to it. A series streams through one task with one number of state."""
    return _by_run(rows, lambda: {"mean": Smooth(period, 2.0 / (period + 1))}, lambda state, x: {"ema": state["mean"].push(x)}, ("ema",))


def rsi(rows: DataFrame, period: int = 14) -> DataFrame:
    """symbol, d, close, rsi (Wilder) where `period` changes lie behind. A series streams through one task with three numbers of state."""

    def step(state: dict, x: np.ndarray) -> dict[str, np.ndarray]:
        before = np.concatenate((x[:1] if state["last"] is None else [state["last"]], x[:-1]))
        changes, skip = x - before, int(state["last"] is None)
        state["last"], out = x[-1], np.full(len(x), np.nan)
        gain, loss = state["gain"].push(np.maximum(changes[skip:], 0)), state["loss"].push(np.maximum(-changes[skip:], 0))
        out[skip:] = 100 - 100 / (1 + gain / np.where(loss == 0, 1e-10, loss))
        return {"rsi": out}

    return _by_run(rows, lambda: {"last": None, "gain": Smooth(period, 1 / period), "loss": Smooth(period, 1 / period)}, step, ("rsi",))


def macd(rows: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """symbol, d, close, macd, signal, histogram where all three are defined."""

    def step(state: dict, x: np.ndarray) -> dict[str, np.ndarray]:
        line, mean = state["fast"].push(x) - state["slow"].push(x), np.full(len(x), np.nan)
        told = ~np.isnan(line)
        mean[told] = state["signal"].push(line[told])
        return {"macd": line, "signal": mean, "histogram": line - mean}

    return _by_run(rows, lambda: {name: Smooth(n, 2.0 / (n + 1)) for name, n in (("fast", fast), ("slow", slow), ("signal", signal))}, step, ("macd", "signal", "histogram"))


def crosses(rows: DataFrame, fast: str, slow: str, symbol: str = "symbol", d: str = "d") -> DataFrame:
    """Rows at which `fast` passes `slow`, with direction up or down."""
    gap = F.col(fast) - F.col(slow)
    before = F.lag(gap).over(_series(symbol, d))
    way = F.when((before <= 0) & (gap > 0), "up").when((before >= 0) & (gap < 0), "down")
    return rows.withColumn("direction", way).where(F.col("direction").isNotNull())


def recent_cross(rows: DataFrame, fast: str, slow: str, lookback: int = 5, symbol: str = "symbol", d: str = "d") -> DataFrame:
    """symbol, direction, days_ago of each symbol's latest cross within its last `lookback` rows."""
    back = F.row_number().over(Window.partitionBy(symbol).orderBy(F.desc(d))) - 1
    gap = F.col(fast) - F.col(slow)
    before = F.lag(gap).over(_series(symbol, d))
    way = F.when((before <= 0) & (gap > 0), "up").when((before >= 0) & (gap < 0), "down")
    found = rows.withColumn("days_ago", back).withColumn("direction", way).where(F.col("direction").isNotNull() & (F.col("days_ago") < lookback))
    return found.groupBy(symbol).agg(F.min("days_ago").alias("days_ago"), F.min_by("direction", "days_ago").alias("direction"))


def ticker(rows: DataFrame, symbol: str = "symbol", d: str = "d", close: str = "close") -> DataFrame:
    """Latest row of each symbol: changes over 1 and 5 rows in percent, distance to the extremes of a year, trend."""
    w = _series(symbol, d)
    year = w.rowsBetween(-251, 0)
    last = F.row_number().over(Window.partitionBy(symbol).orderBy(F.desc(d)))
    pct = lambda n: (F.col(close) / F.lag(close, n).over(w) - 1) * 100
    out = rows.withColumn("pct_1d", pct(1)).withColumn("pct_5d", pct(5)).withColumn("high_52w", F.max(close).over(year)).withColumn("low_52w", F.min(close).over(year))
    out = out.withColumn("mean_20", F.avg(close).over(w.rowsBetween(-19, 0))).withColumn("mean_50", F.avg(close).over(w.rowsBetween(-49, 0))).withColumn("_last", last).where("_last = 1").drop("_last")
    trend = F.when((F.col(close) > F.col("mean_20")) & (F.col("mean_20") > F.col("mean_50")), "up").when((F.col(close) < F.col("mean_20")) & (F.col("mean_20") < F.col("mean_50")), "down").otherwise("flat")
    near = F.when(F.col(close) >= F.col("high_52w") * 0.97, "near high").when(F.col(close) <= F.col("low_52w") * 1.03, "near low").otherwise("between")
    return out.withColumn("trend", trend).withColumn("place_52w", near)
