"""Benchmark decontamination with DataFrame functions alone: SimHash of item-sized windows, Hamming blocks, exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.llm.common import written

#: Words of a shingle and least similarity of a window with an item.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which fingerprints of a window and an item may differ. At the least similarity they differ in 9.6 of 64
#: on average, with a deviation of 2.9; this lies 3.7 deviations above.
RADIUS = 20
#: Rows (hash and id, 32 bytes each) up to which what the scan probes is broadcast.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of a text; null counts as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _grams(array: Column, size: int) -> Column:
    """The n-grams of an array of words, as structs of the words; none if it is shorter."""
    count = F.greatest(F.size(array) - size + 1, F.lit(0))
    return F.arrays_zip(*(F.slice(array, i + 1, count).alias(f"w{i}") for i in range(size)))


def _hash(gram: Column, size: int) -> Column:
    return F.xxhash64(*(gram[f"w{i}"] for i in range(size)))


def _probe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a side that is broadcast if its counted rows fit, else shuffled with the other."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on)


def _shingles(frame: DataFrame, key: list[str], size: int) -> DataFrame:
    """key, gram, h, n: shingles of `ws` with their hash and weight (how often each stands there); the whole sequence if it is shorter than size."""
    short = frame.where((F.size("ws") > 0) & (F.size("ws") < size)).select(*key, F.array_join("ws", " ").alias("gram"))
    n = F.size("ws") - size + 1
    long = frame.where(F.size("ws") >= size).select(*key, F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("ws", i, size), " "))).alias("gram"))
    return long.unionByName(short).groupBy(*key, "gram").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("gram"))


def _fingerprints(shingles: DataFrame, key: list[str]) -> DataFrame:
    """key, total (weights), fp: a bit is 1 if set in over half the weight."""
    ones = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1)) * F.col("n")).alias(f"b{b}") for b in range(64)]
    summed = shingles.groupBy(*key).agg(F.sum("n").alias("total"), *ones)
    bits = [F.shiftleft((2 * F.col(f"b{b}") > F.col("total")).cast("long"), b) for b in range(64)]
    fp = bits[0]
    for bit in bits[1:]:
        fp = fp.bitwiseOR(bit)
    return summed.select(*key, "total", fp.alias("fp"))


def _blocks(fp: str, radius: int) -> Column:
    """radius + 1 blocks of the 64 bits: fingerprints within the radius agree on one at least."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return F.array(*(F.concat_ws(":", F.lit(str(k)), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit(2 ** (b - a) - 1)).cast("string")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start, n_words, distance, similarity: for each document and item the best window of the item's length that is as similar as asked.

    Similarity is that of multisets of word shingles: sum of the lesser weights by sum of the greater ones,
    a shingle's weight being how often it stands there. Of equally similar windows the first is returned.

    A window that shares no shingle with an item has similarity zero, so windows are laid where a shared one
    aligns them; each is fingerprinted, blocks find all fingerprints within the radius of one of an item of
    its length, and the exact similarity decides. Null texts are empty and leak nothing; empty items are
    in no document; items shorter than a shingle are one shingle and are found as such. Rows without an id take
    part with a null id. Repeated rows (same id and text) give one result, other columns are ignored, and empty
    tables give an empty result.
    """
    item = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0).distinct()
    item = written(item.withColumn("item", F.xxhash64("item_id", "ws")).withColumn("length", F.size("ws")), "items")
    item_shingles = written(_shingles(item, ["item", "length"], shingle), "item-shingles")
    item_prints = written(_fingerprints(item_shingles, ["item", "length"]), "item-prints")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = text.withColumn("doc", F.xxhash64("doc_id", "text"))
    sizes = [r["size"] for r in item.select(F.least("length", F.lit(shingle)).alias("size")).distinct().collect()]  # as many as a shingle has words, at most
    laid = None
    for size in sizes:
        fit = F.col("length") == size if size < shingle else F.col("length") >= size
        own = written(item.where(fit).select("length", F.posexplode(_grams(F.col("ws"), size)).alias("item_at", "gram")).select(_hash(F.col("gram"), size).alias("h"), "length", "item_at").distinct(), "anchors")
        seen = text.select("doc", F.posexplode(_grams(words(F.col("text")), size)).alias("at", "gram")).select("doc", "at", _hash(F.col("gram"), size).alias("h"))
        here = _probe(seen, own, ["h"]).select("doc", "length", (F.col("at") - F.col("item_at")).alias("start"))
        laid = here if laid is None else laid.unionByName(here)
    if laid is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, n_words long, distance int, similarity double")
    laid = written(laid.distinct(), "laid")
    there = written(_probe(text, laid.groupBy("doc").agg(F.count("*").alias("laid")), ["doc"]).dropDuplicates(["doc"]).select("doc", "doc_id", words(F.col("text")).alias("all")), "leaking")
    window = laid.join(there, "doc").withColumn("start", F.least(F.greatest("start", F.lit(0)), F.greatest(F.size("all") - F.col("length"), F.lit(0))))
    window = window.select("doc", "doc_id", "length", "start", F.slice("all", F.col("start") + 1, F.col("length")).alias("ws")).dropDuplicates(["doc", "length", "start"])
    window = window.withColumn("window", F.struct("doc", "length", "start"))
    window_shingles = written(_shingles(window.select("window", "doc_id", "length", "ws"), ["window", "doc_id", "length"], shingle), "window-shingles")
    prints = _fingerprints(window_shingles, ["window", "doc_id", "length"])
    left = prints.select("window", "doc_id", "length", "total", "fp", F.explode(_blocks("fp", radius)).alias("block"))
    right = item_prints.select("item", "length", F.col("total").alias("item_total"), F.col("fp").alias("item_fp"), F.explode(_blocks("fp", radius)).alias("block"))
    near = _probe(left, right, ["length", "block"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("distance") <= radius)
    near = near.select("window", "doc_id", "total", "item", "item_total", "distance").distinct()
    shared = near.join(window_shingles.select("window", "gram", "n"), "window").join(item_shingles.select("item", "gram", F.col("n").alias("item_n")), ["item", "gram"])
    common = F.sum(F.least("n", "item_n"))
    alike = shared.groupBy("window", "doc_id", "item", "distance", "total", "item_total").agg(common.alias("common")).withColumn("similarity", F.col("common") / (F.col("total") + F.col("item_total") - F.col("common")))
    best = alike.where(F.col("similarity") >= similarity).groupBy("doc_id", "window.doc", "item").agg(F.min_by(F.struct("window", "distance", "similarity"), F.struct(-F.col("similarity"), F.col("window.start"))).alias("best"))
    return best.join(item.select("item", "item_id"), "item").select("doc_id", "item_id", F.col("best.window.start").cast("long").alias("start"), F.col("best.window.length").cast("long").alias("n_words"), "best.distance", "best.similarity").distinct()
