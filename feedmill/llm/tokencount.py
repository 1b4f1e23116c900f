"""Token counts without token ids: each distinct pre-token is tokenized once, documents hold frequencies of pre-tokens."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedmill.llm.bpe import _FAST, _PLAIN
from feedmill.llm.common import held_alone, small_batches

#: Documents from whose pre-tokens the frequent ones are taken, how many of these are broadcast with their counts, and bytes of each at most: 40 MB together.
SAMPLE_DOCS, FREQUENT, FREQUENT_BYTES = 20_000, 200_000, 200
#: Characters of a text that are split at once.
PART = 200_000
#: Rows of a batch whose frequencies a worker holds at once.
ROWS = 256


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, others for U+0100 onwards."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


class PreTokens:
    """Splits texts as a tokenizers JSON says: added tokens first, then normaliser and pre-tokenizer; and counts the tokens of a pre-token.

    Texts of Latin letters under the usual byte-level pattern are split by the standard library's regex, all
    others by the library's own pre-tokenizer.
    """

    def __init__(self, config: str):
        self.tokenizer, parsed = Tokenizer.from_str(config), json.loads(config)
        pre, added = parsed["pre_tokenizer"], parsed["added_tokens"]
        if pre is None:
            raise ValueError("a tokenizer without a pre-tokenizer has no distinct pre-tokens to count")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or (t["normalized"] and parsed["normalizer"]) for t in added):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.byte_level = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and parsed["normalizer"] is None
        self.letters = byte_letters()

    def _parts(self, text: str) -> Iterator[str]:
        """Parts of a long text, cut where the byte-level pattern always ends a piece: before white space that follows something else."""
        at = 0
        while len(text) - at > PART:
            cut = next((i for i in range(at + PART, len(text)) if text[i] == " " and not text[i - 1].isspace()), len(text))
            yield text[at:cut]
            at = cut
        yield text[at:]

    def frequencies(self, text: str) -> tuple[int, dict[str, int]]:
        """Number of added tokens in a text, and how often each pre-token stands in the rest: under a byte-level pattern as it is written, else as the model gets it."""
        normalizer, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer.pre_tokenize_str
        between, found = self.added.split(text) if self.added else [text], Counter()
        for rest in between:
            if not self.byte_level:
                found.update([piece for piece, _ in split(normalizer.normalize_str(rest) if normalizer else rest)])
                continue
            for part in self._parts(rest):
                found.update(_FAST.findall(part) if _PLAIN.fullmatch(part) else [part[a:b] for _, (a, b) in split(part)])
        return len(between) - 1, found

    def tokens(self, piece: str) -> int:
        """Tokens of one pre-token."""
        return len(self.tokenizer.model.tokenize("".join([self.letters[b] for b in piece.encode()]) if self.byte_level else piece))


def _held(config: str) -> PreTokens:
    return held_alone(("pretokens", config), lambda: PreTokens(config))


_ROWS = "uid long, doc_id long, n_bytes long, tokens long, piece string, k long"


def _frequent(docs: DataFrame, config: str) -> dict[str, int]:
    """Tokens of the pre-tokens that most documents of a sample hold. They only decide which are counted where: any choice gives the same sums."""
    shared, n = docs.sparkSession.sparkContext.broadcast(config), docs.count()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _held(shared.value)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p for p in own.frequencies(text)[1] if len(p.encode()) <= FREQUENT_BYTES], pa.string())], ["piece"])

    few = docs.select("text") if n <= SAMPLE_DOCS else docs.select("text").sample(SAMPLE_DOCS / n, seed=3)
    top = few.mapInArrow(pieces, "piece string").groupBy("piece").count().orderBy(F.desc("count"), "piece").limit(FREQUENT)
    own = PreTokens(config)
    return {r.piece: own.tokens(r.piece) for r in top.collect()}  # FREQUENT rows of FREQUENT_BYTES at most


def counted(docs: DataFrame, config_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row's whole text, as the tokenizers library has it.

    Null and empty texts have no token. Rows are independent: repeated rows repeat, rows without an id keep their
    null; other columns are ignored; an empty table gives an empty result. No special tokens are added, those
    that a text spells out are one token each, and neither truncation nor padding is applied.

    Each document becomes frequencies of pre-tokens. Frequent pre-tokens, tokenized once, are joined where the
    document is; all others meet by shuffle, sorted, so that each distinct one is tokenized once as its run goes by
    and no run is held. A pre-token that one document in 2,000 holds is missing among the frequent ones with a chance of
    e^-10, so no key of the shuffle is hot.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(config_path, encoding="utf-8") as file:
        config = file.read()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    shared = spark.sparkContext.broadcast((config, _frequent(rows, config)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        config, frequent = shared.value
        own = _held(config)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            uids, tokens, owners, rare, times = batch.column("uid").to_pylist(), [], [], [], []
            for uid, text in zip(uids, batch.column("text").to_pylist(), strict=True):
                total, found = own.frequencies(text)
                for piece, k in found.items():
                    n = frequent.get(piece)
                    if n is None:
                        owners.append(uid)
                        rare.append(piece)
                        times.append(k)
                    else:
                        total += n * k
                tokens.append(total)
            nothing = pa.nulls(len(rare), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "n_bytes")), pa.array(tokens, pa.int64()), pa.nulls(len(uids), pa.string()), pa.nulls(len(uids), pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), nothing, nothing, nothing, pa.array(rare, pa.string()), pa.array(times, pa.int64())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, n = _held(shared.value[0]), None, 0
        for batch in batches:
            tokens = batch.column("tokens").to_pylist()
            for at, (piece, k) in enumerate(zip(batch.column("piece").to_pylist(), batch.column("k").to_pylist(), strict=True)):
                if piece is not None:
                    if piece != last:
                        last, n = piece, own.tokens(piece)
                    tokens[at] = n * k
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "n_bytes")), pa.array(tokens, pa.int64())], names[:4])

    names = [column.split()[0] for column in _ROWS.split(", ")]
    dealt = rows.mapInArrow(split, _ROWS).repartition(F.when(F.col("piece").isNull(), F.col("uid")).otherwise(F.xxhash64("piece"))).sortWithinPartitions("piece")
    sums = dealt.mapInArrow(count, ", ".join(_ROWS.split(", ")[:4])).groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
