"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration."""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.llm.common import bucket_of, held_alone, written
from feedmill.llm.training import labelled_sample

#: Labelled rows that the log-odds and the calibration are fitted on, and about how many characters in all.
SAMPLE_ROWS, SAMPLE_CHARS = 20_000, 200_000_000
#: Weight of the Dirichlet prior as a share of the counted tokens, and the deviations by which a log-odds must differ from zero to count; it is drawn one toward zero.
PRIOR, SURE = 0.1, 3.0
#: What every word costs a segment beside its log-odds, so that chance has no drift upward.
DRIFT = 0.2
#: Expected number of such segments in an ordinary text of equal length, below which a passage is significant.
SIGNIFICANT = 0.05

_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first place, last place, score) of the tokens' scores, in one pass.

    Each candidate keeps the sums before and after it; a new one joins back to the last candidate with a smaller
    sum before, as long as that one's sum after is smaller than the new one's.
    """
    kept: list[list] = []  # first, last, sum before, sum after, index of the last candidate with a smaller sum before
    total = 0.0
    for place, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        before, total = total, total + score
        new = [place, place, before, total, len(kept) - 1]
        while True:
            at = new[4]
            while at >= 0 and kept[at][2] >= new[2]:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= new[3]:
                new[4] = at
                kept.append(new)
                break
            new = [kept[at][0], new[1], kept[at][2], new[3], kept[at][4]]
            del kept[at:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


class Model:
    """Scores of the tokens whose log-odds surely differ from zero (all others cost DRIFT), the constants of the extreme-value law, and the weights of the calibration."""

    def __init__(self, odds: dict[str, float], decay: float = 1.0, size: float = 1.0, weights: tuple[float, float] = (-9.0, 0.0)):
        self.odds, self.decay, self.size, self.weights = odds, decay, size, weights

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """(first word, last word, score, logarithm of the number expected by chance) of every maximal segment."""
        get = self.odds.get
        found = segments([get(w, -DRIFT) for w in words]) if self.odds else []
        base = math.log(self.size * len(words)) if found else 0.0
        return [(a, b, s, base - self.decay * s) for a, b, s in found]

    def evidence(self, words: list[str]) -> float:
        """Sum of -ln(expected number) over the significant passages."""
        return sum(-e for *_, e in self.passages(words) if e <= math.log(SIGNIFICANT))

    def score(self, words: list[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + self.weights[1] * self.evidence(words)))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_alone()
    both = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            both[label.as_py() > 0].update(set(tokens(text.as_py())))  # once a text, as words come in bursts
    names = list(both[0] | both[1])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in both)], ["token", "clean", "toxic"])


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum p(s) exp(x s) = 1 under the token scores of clean texts."""
    value = lambda x: (share * np.exp(np.minimum(x * scores, 600))).sum() + max(0.0, 1 - share.sum()) * math.exp(-x * DRIFT) - 1
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weights of a ridge-damped logistic fit by Newton steps."""
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - np.array([1e-6, 1e-2]) * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 1e-2]), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(0.0, w[1]))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> Model:
    """Model from at most `rows` labelled documents with about SAMPLE_CHARS characters outside the held-out fold (see training.labelled_sample).

    Without labels of both kinds no token scores, and every text gets the share of toxic labels (0 without any).
    """
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, rows, SAMPLE_CHARS)
    counts = written(sample.mapInArrow(_counts, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "tokens")
    clean, toxic = counts.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_all, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))).first()
    if not (clean and toxic and 0 < n_toxic < n_all):
        share = n_toxic / n_all if n_all else 0.0
        return Model({}, weights=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0))
    prior = PRIOR * (F.col("clean") + F.col("toxic"))
    one, zero = F.col("toxic") + prior, F.col("clean") + prior
    all_prior = PRIOR * (clean + toxic)
    odds = F.log(one / (toxic + all_prior - one)) - F.log(zero / (clean + all_prior - zero))
    far = F.sqrt(1 / one + 1 / zero)
    drawn = F.signum("odds") * (F.abs("odds") - F.col("far"))
    kept = counts.select("token", odds.alias("odds"), far.alias("far"), (zero / (clean + all_prior)).alias("share")).where(F.abs("odds") > SURE * F.col("far")).select("token", (drawn - DRIFT).alias("score"), "share").collect()  # tokens of the bounded sample
    model = Model({r["token"]: r["score"] for r in kept}, _decay(np.array([r["score"] for r in kept]), np.array([r["share"] for r in kept])))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                words = tokens(text.as_py())
                out.append(len(words) * math.exp(-model.decay * max([0.0, *(s for _, _, s, _ in model.passages(words))])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["y"])

    # Largest sums of clean texts follow exp(-size n exp(-decay s)); this is the likeliest size.
    n, total = sample.where("label = 0").select("text").mapInArrow(largest, "y double").where("y > 0").agg(F.count("*"), F.sum("y")).first()
    model.size = min(10.0, n / total) if total else 1.0

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(tokens(t.as_py())) for t in batch.column(0)], pa.float64()), batch.column(1)], ["x", "label"])

    fitted = sample.select("text", "label").mapInArrow(evidences, "x double, label int").toPandas()  # at most `rows` pairs of numbers
    model.weights = _logistic(fitted["x"].to_numpy(), (fitted["label"].to_numpy() > 0).astype(float))
    return model


def score_column(model: Model):
    """A function of a text column that gives its score."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held_alone()
        for part in texts:
            yield pd.Series([model.score(tokens(t)) for t in part], dtype=float)

    return score


def scored(docs: DataFrame, model: Model, with_passages: bool = False) -> DataFrame:
    """doc_id, score, n_passages of every row, from its whole text; on request the significant passages (word places, score, expected number).

    Null and empty texts score as texts without any passage. Rows are independent: repeated rows repeat, other
    columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, count, lists = [], [], []
            for text in batch.column(1):
                words = tokens(text.as_py())
                found = [p for p in model.passages(words) if p[3] <= math.log(SIGNIFICANT)]
                count.append(len(found))
                score.append(model.score(words))
                lists.append([{"first": a, "last": b, "score": s, "expected": math.exp(e)} for a, b, s, e in found])
            columns = [batch.column(0), pa.array(score, pa.float64()), pa.array(count, pa.int32())]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays(columns + [pa.array(lists, kind)] * with_passages, ["doc_id", "score", "n_passages"] + ["passages"] * with_passages)

    schema = "doc_id long, score double, n_passages int" + ", passages array<struct<first:int,last:int,score:double,expected:double>>" * with_passages
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every row; see fit and scored. A null doc_id is held out of nothing (held_out false)."""
    out = scored(docs, fit(docs, labels, folds, held_out))
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
