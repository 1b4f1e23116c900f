"""SimHash near-duplicates over a Gray-order hierarchical index, and exact groups of similar shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.llm.common import ascii_words, components, held_alone, in_pieces, local_roots, small_batches, written

SEED = 42
#: Words of a shingle of a fingerprint, and bits in which linked fingerprints differ at most.
SHINGLE, RADIUS = 3, 2
#: Fingerprints under one lowest node of the index, and children under each node above.
LEAF, FANOUT = 8, 8
#: For similar_groups: candidates of a document compared at once, rows of a group that one task compares, ids that may be broadcast (8 bytes each).
BUCKET, PIECE, BROADCAST_IDS = 64, 4096, 500_000
#: Shingles that a task counts, that a task deals at once, and that count as one row of a group.
COUNTED, DEALT, ROW = 1 << 20, 1 << 19, 128
#: Rows of the frontier (query x node) that a search holds at once.
FRONTIER = 2_000_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included; the whole sequence if it is shorter."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes; 0 if there are none."""
    return _majority(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; a null text counts as empty."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Rank of each 64-bit word in Gray order: neighbours in this order differ in few bits."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints (rows of 64-bit lanes) in Gray order under a tree whose nodes hold the bits that all below them share.

    A node keeps only the shared bits that its parent does not hold yet (mask) and their values (pattern),
    so the differences from root to leaf add up to the Hamming distance; a group is left as soon as the sum
    exceeds the radius.
    """

    def __init__(self, fps: np.ndarray):
        fps = fps.reshape(len(fps), -1)
        self.order = np.argsort(gray_rank(fps[:, 0]), kind="stable")
        self.fps = fps[self.order]
        levels = [(self.fps, np.full_like(self.fps, 2**64 - 1))]
        width = LEAF
        while len(levels[-1][0]) > 1:
            value, mask = levels[-1]
            starts = np.arange(0, len(value), width)
            ones = np.bitwise_and.reduceat(value & mask, starts)
            zeros = np.bitwise_and.reduceat(~value & mask, starts)
            levels.append((ones, ones | zeros))
            width = FANOUT
        self.levels = []
        for depth, (value, mask) in enumerate(levels):
            if depth + 1 < len(levels):
                mask = mask & ~np.repeat(levels[depth + 1][1], LEAF if depth == 0 else FANOUT, axis=0)[: len(value)]
            self.levels.append((value & mask, mask))

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions (i, j) of the original array and distances, each pair within the radius once, in bounded pieces."""
        n = len(self.fps)
        stack = [(len(self.levels) - 1, np.arange(n - 1), np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64))] if n > 1 else []
        while stack:
            depth, query, node, far = stack.pop()
            if len(query) > FRONTIER // FANOUT and len(query) > 1:
                half = len(query) // 2
                stack += [(depth, query[half:], node[half:], far[half:]), (depth, query[:half], node[:half], far[:half])]
                continue
            pattern, mask = self.levels[depth]
            far = far + np.bitwise_count((self.fps[query] ^ pattern[node]) & mask[node]).sum(axis=1, dtype=np.int64)
            keep = far <= radius
            query, node, far = query[keep], node[keep], far[keep]
            if not len(query):
                continue
            if depth == 0:
                yield self.order[query], self.order[node], far
                continue
            width = LEAF if depth == 1 else FANOUT
            below = len(self.levels[depth - 1][0])
            query, far = np.repeat(query, width), np.repeat(far, width)
            node = (node[:, None] * width + np.arange(width)).ravel()
            span = LEAF * FANOUT ** (depth - 2) if depth > 1 else 1
            keep = (node < below) & ((node + 1) * span - 1 > query)  # each pair once: the second lies after the first
            stack.append((depth - 1, query[keep], node[keep], far[keep]))


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within the groups of one task: a spanning forest of what each group's index finds."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    whole = pa.Table.from_batches(got)
    fps, key, low, high = (whole[c].to_numpy() for c in ("fp", "key", "low", "high"))
    order = np.lexsort((fps, high, low, key))
    named = np.stack([x[order] for x in (key, low, high)])
    starts = np.flatnonzero(np.concatenate(([True], (named[:, 1:] != named[:, :-1]).any(axis=0))))
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        own = fps[order[a:b]]
        if b - a < 2:
            continue
        found = [(i, j) for i, j, _ in GrayIndex(own.view(np.uint64)).pairs(radius)]
        if found:
            root = local_roots(len(own), *(np.concatenate(x) for x in zip(*found, strict=True)))
            far = np.flatnonzero(root != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[far]), pa.array(own[root[far]])], ["u", "v"])


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp) that connect whatever differs in at most radius bits.

    Pigeonhole routing: the 64 bits fall into radius + 2 blocks, so two fingerprints within the radius agree
    on 2 blocks at least. Each fingerprint goes once for every pair of blocks to the group that its values there
    name, and the group's Gray-order index finds all links among what it got. A group of over two pieces is
    searched as pairs of its pieces. Exact at every size.
    """
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    part = [F.expr(f"(shiftrightunsigned(fp, {a}) & {2 ** (b - a) - 1}L)") for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = [F.xxhash64(F.lit(f"{a},{b}"), part[a], part[b]) for a, b in combinations(range(n), 2)]
    dealt = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = written(dealt.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 2 * PIECE), "hot")
    split = in_pieces(dealt, hot, ["key"], "fp", PIECE).select("fp", "key", "low", "high")
    return split.repartition("key", "low", "high").mapInArrow(lambda batches: _links(batches, radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links of <= radius bits).

    Null and empty texts have fingerprint zero and link like any other. Fingerprints are the vertices of the
    link graph, so a group of copies costs one row however large it is. Repeated rows come out as often as
    they came in; rows without doc_id link and bridge like others, and get a null component if nothing that
    they reach has an id. Other columns are ignored. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, shingle), "fps")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    found = components(links(reps.select("fp"), radius))
    named = written(reps.join(found, reps.fp == found.id, "left").select("fp", "rep", F.coalesce("component_id", "fp").alias("vertex")), "named")
    least = named.groupBy("vertex").agg(F.min("rep").alias("component_id"))
    return fps.join(named.join(least, "vertex").select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """uid (of the row), doc_id, fp (the SimHash fingerprint), digest, size, hashes (ascending, 8 bytes each) of the set of shingles of each (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_alone()
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = np.fromiter((fingerprint(shingle_hashes(t.as_py(), SHINGLE)) for t in part.column(1)), np.uint64, part.num_rows)
                found = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part.column(1)]
                raw = [x.tobytes() for x in found]
                digest = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
                sizes = pa.array([len(x) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(raw))), part.column(0), pa.array(fps.view(np.int64)), pa.array(digest, pa.binary()), sizes, pa.array(raw, pa.binary())], ["uid", "doc_id", "fp", "digest", "size", "hashes"])
                uid += len(raw)

    return docs.mapInArrow(run, "uid long, doc_id long, fp long, digest binary, size long, hashes binary")


def _dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Shingles (low 32 bits) by the part of the range of hashes that holds them, with runs of their documents' uid and size."""

    def deal(uids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        flat, sizes = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
        part = ((flat >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 65536 else np.uint32)
        order = np.argsort(part, kind="stable")
        part, low, doc = part[order], flat[order].astype(np.uint32), np.repeat(np.arange(len(sets)), sizes)[order]
        named, starts = np.unique(part, return_index=True)
        columns = [[], [], [], []]
        for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
            first = np.flatnonzero(np.concatenate(([True], doc[a + 1 : b] != doc[a : b - 1])))
            own = doc[a:b][first]
            for column, x in zip(columns, (np.array(uids)[own], sizes[own].astype(np.int32), np.diff(np.append(first, b - a)).astype(np.int32), low[a:b]), strict=True):
                column.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(named.astype(np.int64)), *(pa.array(x, pa.binary()) for x in columns)], ["part", "uids", "sizes", "runs", "low"])

    uids, sets, held = [], [], 0
    for batch in batches:
        for uid, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = np.frombuffer(raw.as_buffer(), np.uint64) if raw.as_buffer().size else np.empty(0, np.uint64)
            if len(found):
                uids.append(uid)
                sets.append(found)
                held += len(found)
            if held >= DEALT:
                yield deal(uids, sets)
                uids, sets, held = [], [], 0
    if sets:
        yield deal(uids, sets)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, size, key, n of each document's shingles whose key several documents (n) have, of the parts of one task."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    whole = pa.Table.from_batches(got)
    uids, sizes, runs, low = (np.frombuffer(b"".join(whole[c].to_pylist()), t) for c, t in (("uids", np.int64), ("sizes", np.int32), ("runs", np.int32), ("low", np.uint32)))
    part = np.repeat(whole["part"].to_numpy(), [len(x) // 4 for x in whole["low"].to_pylist()])
    key = part << 32 | low
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key)))
    n = np.repeat(n, n)
    many = n > 1
    at = np.repeat(np.arange(len(uids)), runs)[order[many]]
    key, n = key[many], n[many]
    for a in range(0, len(at), 65536):
        b = slice(a, a + 65536)
        yield pa.RecordBatch.from_arrays([pa.array(uids[at[b]]), pa.array(sizes[at[b]].astype(np.int64)), pa.array(key[b]), pa.array(n[b])], ["uid", "size", "key", "n"])


def _prefix_length(size: np.ndarray, similarity: float) -> np.ndarray:
    """So many first shingles, in any one order of all, hold a common one of any two similar sets."""
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def _prefixes(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """uid, key of the rarest shingles of each document; those that no other has come first and are not named."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    whole = pa.Table.from_batches(got)
    uid, size, key, n = (whole[c].to_numpy() for c in ("uid", "size", "key", "n"))
    order = np.lexsort((key, n, uid))
    uid, size, key = uid[order], size[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1])))
    many = np.diff(np.append(first, len(uid)))
    take = _prefix_length(size[first], similarity) - (size[first] - many)
    keep = np.arange(len(uid)) - np.repeat(first, many) < np.repeat(take, many)
    yield pa.RecordBatch.from_arrays([pa.array(uid[keep]), pa.array(key[keep])], ["uid", "key"])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0], starts[0] + 1, ... of all ranges of those sizes."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def similar_forest(sets: list[np.ndarray], side: np.ndarray | None, similarity: float, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that link whatever sets (not empty) have that Jaccard similarity or more, each computed exactly, none within what others link.

    side: where given, only pairs of different sides count. known: class of each set by the links that are there already. Sets that share none of their rarest shingles, by
    their frequency among these sets, can't be similar. What is already linked needs no further comparison.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    begin = np.cumsum(size) - size
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((place, count[place], owner))
    chosen = order[np.arange(len(order)) - np.repeat(begin, size) < np.repeat(_prefix_length(size, similarity), size)]
    chosen = chosen[count[place[chosen]] > 1]
    token, doc = place[chosen], owner[chosen]
    start = np.searchsorted(doc, np.arange(len(sets) + 1))
    by_token = np.argsort(token, kind="stable")  # documents of a token ascend
    posts = doc[by_token]
    lists = np.searchsorted(token[by_token], np.arange(len(count) + 1))
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    marked, out = np.zeros(len(count), bool), []
    for x in range(len(sets)):
        own = token[start[x] : start[x + 1]]
        rest = np.unique(posts[_spread(lists[own], lists[own + 1] - lists[own])])
        rest = rest[(rest < x) & (np.minimum(size[rest], size[x]) >= similarity * np.maximum(size[rest], size[x]) - 1e-9)]
        if side is not None:
            rest = rest[side[rest] != side[x]]
        mine = place[begin[x] : begin[x] + size[x]]
        marked[mine] = True
        while len(rest):
            rest = rest[label[rest] != label[x]]
            now, rest = rest[:BUCKET], rest[BUCKET:]
            if not len(now):
                break
            both = np.add.reduceat(marked[place[_spread(begin[now], size[now])]], np.cumsum(size[now]) - size[now], dtype=np.int64)
            for y in now[both >= similarity * (size[now] + size[x] - both)].tolist():
                if label[y] != label[x]:
                    out.append((x, y))
                    label[label == max(label[x], label[y])] = min(label[x], label[y])
        marked[mine] = False
    return out


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (u, v) within the groups of one task, as a forest of each group or pair of its pieces."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    whole = pa.Table.from_batches(got)
    uid, known, piece, low, high, bucket = (whole[c].to_numpy() for c in ("uid", "known", "piece", "low", "high", "bucket"))
    sets = whole["hashes"].to_pylist()
    order = np.lexsort((uid, high, low, bucket))
    named = np.stack([x[order] for x in (bucket, low, high)])
    starts = np.flatnonzero(np.concatenate(([True], (named[:, 1:] != named[:, :-1]).any(axis=0))))
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        at = order[a:b]
        if len(at) > 1:
            found = similar_forest([np.frombuffer(sets[i], np.uint64) for i in at], piece[at] if low[at[0]] != high[at[0]] else None, similarity, known[at])
            if found:
                u, v = at[np.array(found)].T
                yield pa.RecordBatch.from_arrays([pa.array(uid[u]), pa.array(uid[v])], ["u", "v"])


def _compared(once: DataFrame, buckets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of similar sets within the buckets (uid, known, bucket) that connect all those of different known classes there."""
    few = buckets.count() <= BROADCAST_IDS
    held = once.select("uid", "size", "hashes").join(F.broadcast(buckets) if few else buckets, "uid")
    hot = written(held.groupBy("bucket").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") / ROW)).alias("size")).where(F.col("size") > 2 * PIECE), "hot")
    split = in_pieces(held.drop("size"), hot, ["bucket"], "uid", PIECE).select("uid", "known", "bucket", "piece", "low", "high", "hashes")
    return split.repartition("bucket", "low", "high").mapInArrow(lambda b: _alike(b, similarity), "u long, v long")


def _near_prints(once: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of similar sets among those whose fingerprints are connected by links of RADIUS bits at most."""
    prints = written(once.where("size > 0").select("uid", "fp"), "prints")
    found = components(links(prints.select("fp").distinct()))
    named = prints.join(found, prints.fp == found.id, "left").select("uid", F.col("uid").alias("known"), F.coalesce("component_id", "fp").alias("bucket"))
    named = written(named, "named")
    buckets = named.join(named.groupBy("bucket").count().where("count > 1").select("bucket"), "bucket", "left_semi")
    return _compared(once, written(buckets.select("uid", "known", "bucket"), "near"), similarity)


def _rare_shared(once: DataFrame, linked: DataFrame, shingles: int, similarity: float) -> DataFrame:
    """Links (u, v) that connect all similar sets which linked (id, component_id) does not connect, however far apart their fingerprints are."""
    parts = max(1, math.ceil(shingles / COUNTED))
    dealt = once.select("uid", "hashes").mapInArrow(lambda b: _dealt(b, parts), "part long, uids binary, sizes binary, runs binary, low binary")
    shared = dealt.repartition(parts, "part").mapInArrow(_shared, "uid long, size long, key long, n long")
    rare = written(shared.repartition(parts, "uid").mapInArrow(lambda b: _prefixes(b, similarity), "uid long, key long"), "rare")
    lead = rare.groupBy("key").agg(F.min("uid").alias("v"), F.count("*").alias("n")).where("n > 1")
    near = components(rare.join(lead, "key").select(F.col("uid").alias("u"), "v")).select(F.col("id").alias("uid"), F.col("component_id").alias("bucket"))
    near = written(near.join(linked, near.uid == linked.id, "left").select("uid", F.coalesce("component_id", "uid").alias("known"), "bucket"), "near")
    open_ = near.groupBy("bucket").agg((F.min("known") < F.max("known")).alias("open")).where("open").select("bucket")
    return _compared(once, written(near.join(open_, "bucket", "left_semi").select("uid", "known", "bucket"), "open"), similarity)


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id of every row with an id: groups linked by word shingles of that Jaccard similarity or more.

    SimHash comes first: documents whose fingerprints the search of near_duplicates() connects are compared by their
    sets of shingles, so that none goes by its fingerprint alone. Similar texts often differ in more bits than that
    search takes in, so an exact way for the rest follows, for pairs that are not linked yet: shingles are counted
    over all documents, and two sets can only be similar if they share one of the rarest of each, so many that no
    similar pair escapes. Candidates of either way are compared in one task, or in pairs of pieces if they are many,
    set by set; a forest of the similar pairs comes out. Equal sets are one vertex. Exact at every size.

    Null and empty texts are one group. Repeated rows of an id repeat; rows without an id are left out.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sets = written(_shingle_sets(own, shingle), "sets")
    first = written(sets.groupBy("digest").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("rep")), "first")
    copies = written(sets.select("uid").join(first, "uid", "left_anti"), "copies")
    once = sets.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "uid", "left_anti")
    near = written(_near_prints(once, similarity), "alike")
    linked = written(components(near), "linked")
    rest = _rare_shared(once, linked, sets.agg(F.sum("size")).first()[0] or 0, similarity)
    found = components(near.unionByName(rest))
    named = written(first.join(found, first.uid == found.id, "left").select("digest", "rep", F.coalesce("component_id", "uid").alias("vertex")), "named")
    least = named.groupBy("vertex").agg(F.min("rep").alias("component_id"))
    return sets.select("doc_id", "digest").join(named.join(least, "vertex").select("digest", "component_id"), "digest").select("doc_id", "component_id")
