"""What several operators share: batches, pieces of hot groups, word splitting. Tables and components are those of the core."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.operators.components import components
from feedmill.storage import forget, new_path, shared_dir, written

__all__ = ["ascii_words", "bucket_of", "components", "forget", "held_alone", "in_pieces", "local_roots", "new_path", "shared_dir", "small_batches", "whole_groups", "written"]

#: Rows that a Python worker gets at once: with whole texts in them, Spark's 10,000 are tens of MB in the JVM and again in the worker.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS if they are more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_HELD: list = [None, None]


def held_alone(key: object = None, make: Callable[[], object] | None = None) -> object:
    """What a worker keeps from task to task under a key: one thing at a time, so a stage that asks for its own, or for none, frees the one before."""
    if _HELD[0] != key:
        _HELD[:] = None, None
        _HELD[:] = key, make() if make else None
    return _HELD[1]


def in_pieces(dealt: DataFrame, sizes: DataFrame, on: list[str], unit: str, piece: int, broadcast_rows: int = 50_000) -> DataFrame:
    """dealt with piece, low, high: a group of over two pieces of rows is compared as pairs of its pieces.

    sizes: written table of on and size, the groups to split. A row of such a group goes to each pair (low, high)
    that holds its own piece (by hash of `unit`); all other rows get piece 0 of the pair (0, 0).
    """
    n = sizes.count()
    if not n:
        return dealt.withColumns({c: F.lit(0).cast("long") for c in ("piece", "low", "high")})
    out = dealt.join(F.broadcast(sizes) if n <= broadcast_rows else sizes, on, "left").withColumn("pieces", F.ceil(F.coalesce("size", F.lit(1)) / piece).cast("long"))
    out = out.withColumn("piece", F.pmod(F.xxhash64(unit), "pieces")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    return out.withColumn("low", F.least("piece", "other")).withColumn("high", F.greatest("piece", "other")).drop("size", "pieces", "other")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by those columns, one at a time; no more is held than a group and a batch."""
    parts: list[pa.Table] = []  # of the group that the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        named = np.stack([table[c].to_numpy() for c in by])
        starts = [0, *(np.flatnonzero((named[:, 1:] != named[:, :-1]).any(axis=0)) + 1), table.num_rows]
        if parts and any(parts[-1][c][-1].as_py() != table[c][0].as_py() for c in by):
            yield pa.concat_tables(parts)
            parts = []
        for a, b in zip(starts, starts[1:], strict=False):
            if a:
                yield pa.concat_tables(parts)
                parts = []
            parts.append(table.slice(a, b - a))
    if parts:
        yield pa.concat_tables(parts)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links i-j reach, by label passing with pointer jumps."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == label).all():
            break
        label = new
    return label


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text after A-Z are lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n: the folds that the contracts name."""
    return F.crc32(doc_id.cast("string")) % n
