"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.llm.common import bucket_of, small_batches
from feedmill.llm.training import labelled_sample

#: Labelled rows that the machine is fitted on, and about how many characters in all: their features are held at once.
SAMPLE_ROWS, SAMPLE_CHARS = 10_000, 100_000_000
#: Buckets of hashed words, steps of a statistic, and the length of each feature's vector.
WORD_BUCKETS, STEPS, RANK = 1 << 15, 24, 8
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.05, 1e-5

_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"[^\w\s]")
STATISTICS = ("characters", "words", "word length", "capitals", "digits", "signs", "odd signs", "distinct words", "lines", "distinct lines", "line length", "commonest word", "white space", "long words", "letters", "bytes a character")


def statistics(text: str, words: list[str]) -> list[float]:
    """Each of STATISTICS from 0 to 1: shares as they are, sizes by their logarithm."""
    n = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    signs = _SIGN.findall(text)
    letters = sum(map(len, words))
    log = lambda x, top: min(1.0, math.log1p(x) / math.log1p(top))
    return [
        log(len(text), 1e6), log(len(words), 1e5), min(1.0, letters / max(1, len(words)) / 20), sum(1 for c in text if c.isupper()) / max(1, letters), min(1.0, sum(map(text.count, "0123456789")) / n * 5),
        min(1.0, len(signs) / n * 3), sum(1 for c in signs if c not in ".,;:'\"!?-()") / max(1, len(signs)), len(counts) / max(1, len(words)), log(len(lines), 1e4), len(set(lines)) / max(1, len(lines)),
        log(len(text) / max(1, len(lines)), 1e5), max(counts.values(), default=0) / max(1, len(words)), min(1.0, sum(map(text.count, " \n\t")) / n * 2), sum(1 for w in words if len(w) > 15) / max(1, len(words)), letters / n, (len(text.encode("utf-8", "surrogatepass")) / n - 1) / 3,
    ]


#: What is known of a document beside its text: the length that its table states, and how that agrees with the text.
METADATA = ("stated length", "agreement")


def metadata(text: str, n_chars: int | None) -> list[int]:
    """A step of each of METADATA; step 0 if the table states nothing."""
    if n_chars is None:
        return [0, 0]
    return [1 + min(STEPS - 2, int(math.log1p(max(0, n_chars)))), 1 + (n_chars > len(text)) + 2 * (n_chars < len(text))]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: a step of each statistic and of the metadata, and the distinct hashed words."""
    text = text or ""
    words = _WORD.findall(text)
    stats = [min(STEPS - 1, int(x * STEPS)) for x in statistics(text, words)]
    stats += metadata(text, n_chars)
    fixed = [i * STEPS + x for i, x in enumerate(stats)]
    hashed = np.unique(np.fromiter((zlib.crc32(w.encode()) for w in {w.lower() for w in words}), np.int64) % WORD_BUCKETS)
    index = np.concatenate((fixed, hashed + len(stats) * STEPS)).astype(np.int64)
    value = np.concatenate((np.full(len(fixed), 1 / math.sqrt(len(fixed))), np.full(len(hashed), 1 / math.sqrt(max(1, len(hashed))))))
    return index, value


WIDTH = (len(STATISTICS) + len(METADATA)) * STEPS + WORD_BUCKETS


class Machine:
    """y = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the pairs by (sum)^2 - sum of squares, in linear time."""

    def __init__(self, bias: float = 0.0, weights: np.ndarray | None = None, vectors: np.ndarray | None = None):
        self.bias = bias
        self.weights = np.zeros(WIDTH, np.float32) if weights is None else weights
        self.vectors = np.zeros((WIDTH, RANK), np.float32) if vectors is None else vectors

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.vectors[index] * value[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.weights[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, text: str | None, n_chars: int | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(*features(text, n_chars))))))

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        """Logistic loss by AdaGrad over shuffled batches, the same for the same rows."""
        rng = np.random.default_rng(11)
        w, v = np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, RANK))
        seen_w, seen_v = np.full(WIDTH, 1e-3), np.full((WIDTH, RANK), 1e-3)
        bias = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                part = order[at : at + BATCH]
                index = np.concatenate([rows[i][0] for i in part])
                x = np.concatenate([rows[i][1] for i in part])
                sizes = np.array([len(rows[i][0]) for i in part])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                vx = v[index] * x[:, None]
                total = np.add.reduceat(vx, starts)
                z = bias + np.add.reduceat(w[index] * x, starts) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                gx = np.repeat(g, sizes) * x
                used, place = np.unique(index, return_inverse=True)
                grad_w = np.bincount(place, gx, len(used)) + DECAY * w[used]
                pair = gx[:, None] * (np.repeat(total, sizes, axis=0) - vx)
                grad_v = np.stack([np.bincount(place, pair[:, k], len(used)) for k in range(RANK)], axis=1) + DECAY * v[used]
                seen_w[used] += grad_w**2
                seen_v[used] += grad_v**2
                w[used] -= RATE * 4 * grad_w / np.sqrt(seen_w[used])
                v[used] -= RATE * grad_v / np.sqrt(seen_v[used])
                bias -= RATE * g.sum()
        self.bias, self.weights, self.vectors = bias, w.astype(np.float32), v.astype(np.float32)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, y, keys = [], [], []
    for batch in batches:
        for text, label, n_chars in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            value = text.as_py()
            rows.append(features(value, n_chars))
            y.append(float(label.as_py() > 0))
            keys.append(zlib.crc32((value or "").encode("utf-8", "surrogatepass")))
    order = np.argsort(keys, kind="stable")  # the same fit whatever order rows arrive in
    machine = Machine()
    if rows:
        machine.train([rows[i] for i in order], np.array(y)[order])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((machine.bias, machine.weights, machine.vectors))], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> Machine:
    """Machine from at most `rows` labelled documents with about SAMPLE_CHARS characters outside the held-out fold, fitted in one task that keeps features alone.

    Without labels every text scores 0.5; with labels of one kind only, near that label.
    """
    sample = labelled_sample(_stated(docs), labels, "quality", folds, held_out, rows, SAMPLE_CHARS, ("n_chars",))
    made = sample.select("text", "label", "n_chars").coalesce(1).mapInArrow(_train, "model binary").collect()  # one row
    return Machine(*pickle.loads(made[0]["model"])) if made else Machine()


def _stated(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars; a table without n_chars states nothing."""
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stated.alias("n_chars"))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every row from its whole text; null and empty texts score by their statistics, a null n_chars as one that states nothing. Rows are independent: repeated rows repeat; other columns are ignored; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*shared.value)
        for batch in batches:
            out = []
            for text, n_chars in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                out.append(own.score(text.as_py(), n_chars))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return _stated(docs).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold) of every row. A null doc_id is held out of nothing (held_out false)."""
    out = scored(docs, fit(docs, labels, folds, held_out))
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
