"""Embedding near-duplicates by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.llm.common import components, in_pieces, local_roots, whole_groups, written

#: Vectors that one bucket holds on average, whatever their number: key bits grow with its logarithm.
BUCKET = 512
#: Chance with which a pair exactly at the threshold shares a bucket of some table; closer pairs do more often.
RECALL = 0.999
#: Deviations that the bound on an estimate allows; beyond it a link would be missed with chance below 1e-4.
DEVIATIONS = 4.0
#: Rows of a bucket that one task compares with one another; a larger bucket is dealt as pairs of pieces.
PIECE = 1024


def rotations(dim: int, number: int, seed: int = 7) -> np.ndarray:
    """That many random orthogonal matrices, side by side: dim x (dim * number)."""
    rng = np.random.default_rng([seed, dim])
    parts = []
    for _ in range(number):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1)


class Codes:
    """Rotated unit vectors, their signs, the correction factor of each, and bucket keys cut from the signs."""

    def __init__(self, dim: int, tables: int, bits: int):
        self.dim, self.tables, self.bits = dim, tables, bits
        self.turns = rotations(dim, max(1, math.ceil(tables * bits / dim)))

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """rotated, signs (+1 or -1), factor <code, vector> in the first rotation; keys (rows x tables)."""
        turned = unit @ self.turns
        first = turned[:, : self.dim]
        signs = np.where(first > 0, 1.0, -1.0)
        factor = np.abs(first).sum(axis=1) / math.sqrt(self.dim)
        return first, signs, factor, self.keys(turned > 0)

    def keys(self, set_: np.ndarray) -> np.ndarray:
        """Bucket keys (rows x tables) of set bits, one a column."""
        return set_[:, : self.tables * self.bits].reshape(len(set_), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))

    def packed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """rotated, the bits of all rotations' signs as bytes (the code stands first), factor, keys."""
        turned = unit @ self.turns
        first = turned[:, : self.dim]
        return first, np.packbits(turned > 0, axis=1), np.abs(first).sum(axis=1) / math.sqrt(self.dim), self.keys(turned > 0)


def estimate(signs: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors (rows) with rotated ones (columns)."""
    return (signs @ rotated.T) / (math.sqrt(signs.shape[1]) * factor[:, None])


def margin(factor: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """How far an estimate may lie below a true inner product of threshold or more.

    The error is sqrt(1 - f^2) / f * sqrt(1 - s^2) times one coordinate of a random unit vector in dim - 1
    dimensions, where f is the correction factor and s >= threshold the inner product.
    """
    wide = np.minimum(1.0, DEVIATIONS / math.sqrt(max(1, dim - 1)))
    return np.sqrt(np.maximum(0, 1 - factor**2)) / factor * math.sqrt(max(0.0, 1 - threshold**2)) * wide + 1e-9


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id, key (digest of the vector, null if it can link with nothing), dim, vec (doubles as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, raws = [], [], []
            for value in batch.column(1):
                items = value.as_py()
                x = np.array([np.nan if v is None else v for v in items or []], np.float64) + 0.0
                fit = len(x) > 0 and np.isfinite(x).all() and x.any()
                raw = x.tobytes() if fit else None
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if fit else None)
                dims.append(len(x) if fit else None)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], ["vec_id", "key", "dim", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, key binary, dim int, vec binary")


def _unit(raw: list[bytes] | pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stored(coder: Codes):
    """What is stored of each vector: its code, correction factor, rotation in single bytes with their scale and what that rounding loses, bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, bits, factor, keys = coder.packed(_unit(batch.column("vec").to_pylist(), coder.dim))
                scale = np.abs(first).max(axis=1) / 127
                whole = np.rint(first / scale[:, None]).astype(np.int8)
                lost = np.linalg.norm(first - whole * scale[:, None], axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * coder.tables), pa.array(keys.ravel()))
                codes = [pa.array([r.tobytes() for r in part], pa.binary()) for part in (bits, whole)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "uid", "copies")), codes[0], pa.array(factor), codes[1], pa.array(scale), pa.array(lost), flat], _names(STORED + ", keys array<long>"))

    return run


#: Columns of a stored code, and those that name the group a row is compared in.
STORED = "key binary, uid long, copies long, bits binary, factor double, turned binary, scale double, lost double"
GROUP = "tab int, bucket long, low long, high long"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


class Bucket:
    """Stored codes of one group of rows, and the pairs of them that the bounds leave open."""

    def __init__(self, coder: Codes, threshold: float, rows: pa.Table):
        self.dim = coder.dim
        signs = np.unpackbits(np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1)
        self.keys = coder.keys(signs)[:, : rows["tab"][0].as_py()]  # of the tables before this one
        self.signs = np.where(signs[:, : self.dim], np.float32(1), np.float32(-1))
        self.turned = np.frombuffer(b"".join(rows["turned"].to_pylist()), np.int8).reshape(-1, self.dim).astype(np.float32)
        self.factor, self.scale, lost = (rows[c].to_numpy() for c in ("factor", "scale", "lost"))
        # estimate >= threshold - margin - lost / factor, times factor * sqrt(dim); single precision adds less than 1e-5
        self.least = ((threshold - margin(self.factor, self.dim, threshold) - 1e-5) * self.factor * math.sqrt(self.dim)).astype(np.float32)
        self.spare = (lost * math.sqrt(self.dim)).astype(np.float32)
        self.scale = self.scale.astype(np.float32)
        low, high, piece = rows["low"][0].as_py(), rows["high"][0].as_py(), rows["piece"].to_numpy()
        self.across = low != high
        self.left = np.flatnonzero(piece == low) if self.across else np.arange(rows.num_rows)
        self.right = np.flatnonzero(piece == high) if self.across else self.left

    def open_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose estimates, from the code of either side, lie within the bounds and that no earlier table brought together."""
        for a in range(0, len(self.left), 512):
            rowset = self.left[a : a + 512]
            maybe = (self.signs[rowset] @ self.turned[self.right].T) * self.scale[self.right] + self.spare[self.right] >= self.least[rowset][:, None]
            p, q = np.nonzero(maybe)
            if not self.across:
                p, q = p[q > p + a], q[q > p + a]
            p, q = rowset[p], self.right[q]
            for b in range(0, len(p), 50_000):
                i, j = p[b : b + 50_000], q[b : b + 50_000]
                back = np.einsum("ij,ij->i", self.signs[j], self.turned[i]) * self.scale[i] + self.spare[i] >= self.least[j]
                i, j = i[back], j[back]
                fresh = ~(self.keys[i] == self.keys[j]).any(axis=1)
                yield i[fresh], j[fresh]


def _survivors(coder: Codes, threshold: float):
    """The rows of each group that stand in a pair which needs exact computation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, _names(GROUP)):
            if rows.num_rows < 2:
                continue
            used = np.zeros(rows.num_rows, bool)
            for i, j in Bucket(coder, threshold, rows).open_pairs():
                used[i] = used[j] = True
            if used.any():
                yield from rows.filter(pa.array(used)).combine_chunks().to_batches()

    return run


def _compared(coder: Codes, threshold: float):
    """Links within each group: for each vector the copies it links with and the least uid it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, _names(GROUP)):
            unit, copies = _unit(rows["vec"].to_pylist(), coder.dim), rows["copies"].to_numpy()
            count, ii, jj = np.zeros(len(unit), np.int64), [], []
            for i, j in Bucket(coder, threshold, rows).open_pairs():  # only these pairs are computed in full
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[near], j[near]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                ii.append(i)
                jj.append(j)
            if not count.any():
                continue
            ids, place = np.unique(rows["uid"].to_numpy(), return_inverse=True)
            root, total = local_roots(len(ids), place[np.concatenate(ii)], place[np.concatenate(jj)]), np.zeros(len(ids), np.int64)
            np.add.at(total, place, count)
            used = np.flatnonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(total[used]), pa.array(ids[root[used]])], ["uid", "n", "root"])

    return run


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a bucket key and number of tables for n vectors."""
    bits = min(40, max(4, round(math.log2(max(n, 2) / BUCKET))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - share))


def _links(unique: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    bits, tables = tables_for(n, threshold)
    coder = Codes(dim, tables, bits)
    own = unique.where(F.col("dim") == dim)
    codes = written(own.select("key", "uid", "copies", "vec").mapInArrow(_stored(coder), STORED + ", keys array<long>"), "codes")
    hot = written(codes.select(F.posexplode("keys").alias("tab", "bucket")).groupBy("tab", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > 2 * PIECE), "hot")
    dealt = in_pieces(codes.select(*_names(STORED), F.posexplode("keys").alias("tab", "bucket")), hot, ["tab", "bucket"], "uid", PIECE)
    group, columns = _names(GROUP), [*_names(GROUP), "piece", *_names(STORED)]
    dealt = dealt.select(*columns).repartition(*group).sortWithinPartitions(*group)
    left = written(dealt.mapInArrow(_survivors(coder, threshold), f"{GROUP}, piece long, {STORED}"), "survivors")
    exact = left.join(own.select("key", "vec"), "key").select(*columns, "vec").repartition(*group).sortWithinPartitions(*group)
    return exact.mapInArrow(_compared(coder, threshold), "uid long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for links of cosine >= threshold, one row for each input row.

    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing and is its
    own component; vectors of different lengths never link. Equal vectors count as one with a number of copies.
    Repeated rows count as vectors of their own that share an id. Ties at the threshold link. A row without
    vec_id still counts as a link of others, and has a null component if nothing with an id is in reach. Other columns are ignored.

    Candidates share a bucket, that is the bits of a randomised rotation's signs that a table takes; a pair
    counts in the first table where it does. Codes, correction factors and rotations rounded to bytes are stored
    once and stand for the vectors in the buckets; estimates from either side's code with their confidence bounds
    decide which rows of a bucket are joined with their vectors and which pairs are computed in double precision;
    only that result links. Tasks hold a group at a time and give back counts and spanning forests, never pairs.
    """
    spark = vectors.sparkSession
    base = written(_clean(vectors), "vectors")
    unique = base.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    unique = written(unique.withColumn("uid", F.monotonically_increasing_id()), "unique")  # a vertex is a vector, whatever ids its rows have
    found = spark.createDataFrame([], "uid long, n long, root long")
    for row in unique.groupBy("dim").count().collect():  # as many rows as the table has vector lengths
        found = found.unionByName(_links(unique, row["dim"], row["count"], threshold))
    found = written(found, "links")
    sums = found.groupBy("uid").agg(F.sum("n").alias("n"))
    joined = written(components(found.select(F.col("uid").alias("u"), F.col("root").alias("v"))), "joined")
    named = joined.join(unique.select(F.col("uid").alias("id"), "least_id"), "id").groupBy("component_id").agg(F.min("least_id").alias("named"))
    reached = joined.join(written(named, "named"), "component_id").select(F.col("id").alias("uid"), "named", F.lit(True).alias("linked"))
    each = unique.select("key", "uid", "copies", "least_id").join(sums, "uid", "left").join(reached, "uid", "left")
    each = each.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.when(F.col("linked"), F.col("named")).otherwise(F.col("least_id")).alias("component_id"))
    out = base.select("vec_id", "key").join(each, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
