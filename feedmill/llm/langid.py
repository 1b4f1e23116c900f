"""Language ID of code-switched text: a linear-chain conditional random field over words."""

import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.llm.common import bucket_of, held_alone, small_batches
from feedmill.llm.training import sample_by_class

#: Documents of each language, about how many in all, and about how many characters in all, that the field is fitted on. Every language that the documents name is learned.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_CHARS = 300, 20_000, 24_000_000
#: Words of one language in a training sequence; two such runs of any two languages make one sequence.
RUN = 24
#: Share of a language's sampled documents that hold a word of its lexicon, and bits of a hashed feature's bucket.
LEXICON, BUCKET_BITS = 0.02, 16
BUCKETS = 1 << BUCKET_BITS
EPOCHS, RATE, RIDGE = 14, 0.15, 1e-3
#: Training sequences of a step, and those of them that are held at once.
STEP, TOGETHER = 4096, 512
#: Words x languages that a forward-backward pass over padded texts holds at once, texts split into words at once, words whose scores a worker keeps.
CELLS, ROWS, CACHE = 500_000, 1024, 100_000
#: Characters beyond which a text is taken in pieces of so many words.
LONG, PIECE = 200_000, 8192

_WORD = re.compile(r"[^\W\d_]+")  # letters, and signs of numbers, which words_in takes out


def words_in(text: str | None) -> Iterator[str]:
    """Runs of letters of a text, lower-cased, one after another."""
    for found in _WORD.finditer((text or "").lower()):
        word = found[0]
        if word.isalpha():
            yield word
        else:
            yield from "".join(c if c.isalpha() else " " for c in word).split()


def words_of(text: str | None) -> list[str]:
    found = _WORD.findall((text or "").lower())
    return found if all(map(str.isalpha, found)) else list(words_in(text))


def _bucket(kind: int, *signs: np.ndarray) -> np.ndarray:
    """Bucket of up to three code points each, for one kind of feature."""
    x = np.full(len(signs[0]), 0x9E3779B97F4A7C15 * (kind + 1) & (2**64 - 1), np.uint64)
    for i, sign in enumerate(signs):
        x ^= sign << np.uint64(21 * i)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(words: list[str], lexicons: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct non-empty words: buckets of their affixes, character n-grams and the lexicons that hold them; the word of each bucket."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sign = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes + 2) - sizes - 2
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    inside = owner[:-1] == owner[1:]
    both = inside[:-1] & inside[1:]
    found = [(_bucket(0, sign[:-1][inside], sign[1:][inside]), owner[:-1][inside]), (_bucket(1, sign[:-2][both], sign[1:-1][both], sign[2:][both]), owner[:-2][both])]
    for n in (1, 2, 3):
        long = np.flatnonzero(sizes > n)
        first, last = starts[long] + 1, starts[long] + sizes[long]
        found.append((_bucket(1 + n, *(sign[first + i] for i in range(n))), long))
        found.append((_bucket(4 + n, *(sign[last - i] for i in range(n))), long))
    known = [(i, w) for i, w in enumerate(words) if w in lexicons]
    listed = [(k, i) for i, w in known for k in lexicons[w]]
    found.append((_bucket(8, np.array([k for k, _ in listed], np.uint64)), np.array([i for _, i in listed], np.int64)))
    found.append((np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % (1 << BUCKET_BITS) for _, w in known], np.int64), np.array([i for i, _ in known], np.int64)))
    other = np.ones(len(words), bool)
    other[[i for i, _ in known]] = False
    other = np.flatnonzero(other)
    found.append((_bucket(9, np.zeros(len(other), np.uint64)), other))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def marginals(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: word marginals (B x T x K), summed pair marginals (K x K), and a factor per step.

    scores: word scores (logarithms), moves: transition scores. Both passes are rescaled at each word.
    """
    rows, steps, kinds = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(moves - moves.max())
    alive = np.arange(steps)[None, :] < lengths[:, None]
    ahead = np.empty_like(emit)
    back = np.empty_like(emit)
    scale = np.ones((rows, steps))
    now = np.full((rows, kinds), 1.0 / kinds)
    for t in range(steps):
        new = (now if t == 0 else now @ step) * emit[:, t]
        total = new.sum(axis=1)
        scale[:, t] = total
        now = new / total[:, None]
        ahead[:, t] = now
    now = np.ones((rows, kinds))
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            new = ((emit[:, t + 1] * now) @ step.T) / scale[:, t + 1][:, None]
            now = np.where(alive[:, t + 1][:, None], new, 1.0)
        back[:, t] = now
    each = ahead * back
    each /= each.sum(axis=2, keepdims=True)
    each *= alive[:, :, None]
    pairs = np.zeros((kinds, kinds))
    if steps > 1 and with_pairs:
        left = ahead[:, :-1].reshape(-1, kinds)
        weight = (alive[:, 1:] / scale[:, 1:]).reshape(-1, 1)
        right = (emit[:, 1:] * back[:, 1:]).reshape(-1, kinds) * weight
        joint = (left @ step) * right
        norm = np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        pairs = step * (left.T @ (right / norm * (weight > 0)))
    return each, pairs, alive


class Field:
    """Weights of the features for each language, learned transitions, lexicons, and the languages' names."""

    def __init__(self, names: list[str], lexicons: dict[str, tuple[int, ...]], weights: np.ndarray, moves: np.ndarray):
        self.names, self.lexicons, self.weights, self.moves = names, lexicons, weights, moves
        self.known: dict[str, int] = {}  # place of each word's scores in the table
        self.table = np.empty((1024, len(names)), np.float32)

    def _meet(self, words: Iterable[str]) -> None:
        """Scores of the words in the table; those of words not met before are added up together."""
        if len(self.known) > CACHE:
            self.known.clear()
        known, start = self.known, len(self.known)
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            column, row = features(new, self.lexicons)
            known.update(zip(new, range(start, start + len(new)), strict=True))
            while len(known) > len(self.table):
                self.table = np.concatenate((self.table, np.empty_like(self.table)))
            for k in range(len(self.names)):
                self.table[start : start + len(new), k] = np.bincount(row, self.weights[column, k], len(new))

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals (words x languages) of each text, texts of like length together."""
        out: list[np.ndarray] = [np.empty((0, len(self.names)))] * len(texts)
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        kinds = len(self.names)
        while order:
            steps = len(texts[order[0]])
            group = order[: max(1, CELLS // (steps * kinds))]
            order = order[len(group) :]
            self._meet(chain.from_iterable(texts[i] for i in group))
            known = self.known
            scores = np.zeros((len(group), steps, kinds))
            for row, i in enumerate(group):
                scores[row, : len(texts[i])] = self.table[[known[w] for w in texts[i]]]
            each = marginals(scores, self.moves, np.array([len(texts[i]) for i in group]), with_pairs=False)[0]
            for row, i in enumerate(group):
                out[i] = each[row, : len(texts[i])]
        return out

    def _sums(self, text: str) -> tuple[np.ndarray, int]:
        """Summed marginals and number of words of a very long text: forward over its pieces, then back, each piece's forward pass made anew."""
        step = np.exp(self.moves - self.moves.max())
        pieces, starts, total, n = [], [np.full(len(self.names), 1.0 / len(self.names))], np.zeros(len(self.names)), 0

        def ahead(emit: np.ndarray, now: np.ndarray, first: bool) -> np.ndarray:
            out = np.empty_like(emit)
            for t in range(len(emit)):
                now = (now if first and t == 0 else now @ step) * emit[t]
                now /= now.sum()
                out[t] = now
            return out

        found = words_in(text)
        while words := list(islice(found, PIECE)):
            self._meet(words)
            scores = self.table[[self.known[w] for w in words]]
            pieces.append(np.exp(scores - scores.max(axis=1, keepdims=True)))  # single precision, 4 bytes for each word and language
            starts.append(ahead(pieces[-1].astype(float), starts[-1], len(pieces) == 1)[-1])
            n += len(words)
        back = np.ones(len(self.names))
        for k in range(len(pieces) - 1, -1, -1):
            emit = pieces[k].astype(float)
            front = ahead(emit, starts[k], k == 0)
            for t in range(len(emit) - 1, -1, -1):
                each = front[t] * back
                total += each / each.sum()
                back = step @ (emit[t] * back)
                back /= back.sum()
        return total, n

    def document(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language of most expected words in each text and its share; und and 0 for texts without a letter."""
        if not self.names:
            return [("und", 0.0)] * len(texts)
        found = [(m.sum(axis=0), len(m)) for m in self.label([words_of(t) if len(t or "") <= LONG else [] for t in texts])]
        found = [self._sums(t) if len(t or "") > LONG else x for t, x in zip(texts, found, strict=True)]
        return [(self.names[int(total.argmax())], float(min(1.0, total.max() / n))) if n else ("und", 0.0) for total, n in found]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_alone()
    rows, number, holders = [], {}, {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            value = text.as_py()
            words = words_of(value)
            if words:  # places of words in `number` stand for the words
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                rows.append((lang, zlib.crc32(value.encode("utf-8", "surrogatepass")), ids.tobytes()))
                holders.setdefault(lang, Counter()).update(np.unique(ids).tolist())
    names = sorted(holders)
    if not names:
        return
    vocabulary = list(number)
    order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)  # the same fit whatever order rows arrive in
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    texts = sorted((crc, names.index(lang), place[np.frombuffer(ids, np.int32)].astype(np.int32).tobytes()) for lang, crc, ids in rows)
    sizes = Counter(lang for lang, _, _ in rows)
    lexicons: dict[str, tuple[int, ...]] = {}
    for k, lang in enumerate(names):
        least = max(2, LEXICON * sizes[lang])
        for word in sorted(vocabulary[i] for i, n in holders[lang].items() if n >= least):
            lexicons[word] = (*lexicons.get(word, ()), k)
    weights, moves = _fitted([vocabulary[i] for i in order], [(np.frombuffer(ids, np.int32), k) for _, k, ids in texts], lexicons, len(names))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((names, lexicons, weights, moves))], pa.binary())], ["model"])


def _fitted(vocabulary: list[str], texts: list[tuple[np.ndarray, int]], lexicons: dict[str, tuple[int, ...]], kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by AdaGrad over steps of STEP sequences, of which TOGETHER are held at once."""
    held = len(vocabulary)
    column, row = features(vocabulary, lexicons)
    runs = [(words[i : i + RUN], k) for words, k in texts for i in range(0, len(words), RUN)]
    rng = np.random.default_rng(5)
    order = rng.permutation(len(runs))
    ids, gold = np.zeros((len(runs), 2 * RUN), np.int32), np.full((len(runs), 2 * RUN), -1, np.int32)
    lengths = np.zeros(len(runs), np.int64)
    for at, (one, two) in enumerate(zip(range(len(runs)), order, strict=True)):
        parts = [runs[one], runs[two]] if at % 2 else [runs[one]]  # half of the sequences switch, or may
        flat = np.concatenate([p for p, _ in parts])
        lengths[at] = len(flat)
        ids[at, : len(flat)] = flat
        gold[at, : len(flat)] = np.repeat([k for _, k in parts], [len(p) for p, _ in parts])
    weights, moves = np.zeros((BUCKETS, kinds)), np.zeros((kinds, kinds))
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(EPOCHS):
        for at in range(0, len(runs), STEP):
            table = np.stack([np.bincount(row, weights[column, k], held) for k in range(kinds)], axis=1)
            word_grad, joint, words = np.zeros((held, kinds)), np.zeros_like(moves), 0
            for start in range(at, min(at + STEP, len(runs)), TOGETHER):
                part = slice(start, min(start + TOGETHER, at + STEP))
                each, pairs, alive = marginals(table[ids[part]], moves, lengths[part])
                diff = ((gold[part][:, :, None] == np.arange(kinds)) - each)[alive]
                here = ids[part][alive]
                word_grad += np.stack([np.bincount(here, diff[:, k], held) for k in range(kinds)], axis=1)
                words += len(here)
                both = alive[:, 1:]
                np.add.at(joint, (gold[part][:, :-1][both], gold[part][:, 1:][both]), 1)
                joint -= pairs
            grad = np.stack([np.bincount(column, word_grad[row, k], BUCKETS) for k in range(kinds)], axis=1) / words - RIDGE * weights / len(runs)
            move_grad = joint / words - RIDGE * moves
            seen_w += grad**2
            seen_m += move_grad**2
            weights += RATE * grad / np.sqrt(seen_w)
            moves += RATE * move_grad / np.sqrt(seen_m)
    return weights, moves


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> Field:
    """Field from text and lang of at most `rows` documents of each language outside the held-out fold, and about SAMPLE_TOTAL with SAMPLE_CHARS characters in all, fitted in one task. Without any, no language is known and all texts are und."""
    made = sample_by_class(docs, "lang", folds, held_out, rows, SAMPLE_TOTAL, SAMPLE_CHARS).select("text", "label").coalesce(1).mapInArrow(_train, "model binary").collect()  # one row
    return Field(*pickle.loads(made[0]["model"])) if made else Field([], {}, np.zeros((BUCKETS, 0)), np.zeros((0, 0)))


def language_column(field: Field, spark: SparkSession):
    """A function of a text column that gives (lang_pred, score)."""
    small_batches(spark)
    shared, mark = spark.sparkContext.broadcast((field.names, field.lexicons, field.weights, field.moves)), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held_alone(mark, lambda: Field(*shared.value))
        for part in texts:
            found = [x for at in range(0, len(part), ROWS) for x in own.document(list(part.iloc[at : at + ROWS]))]
            yield pd.DataFrame({"lang_pred": pd.Series([a for a, _ in found], dtype=str), "score": pd.Series([b for _, b in found], dtype=float)})

    return language


def identified(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred, score of every row from its whole text. Null texts and texts without letters (Unicode L; signs of numbers are none) are und with score 0. Rows are independent: repeated rows repeat; other columns are ignored; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    shared, mark = docs.sparkSession.sparkContext.broadcast((field.names, field.lexicons, field.weights, field.moves)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held_alone(mark, lambda: Field(*shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = own.document(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. A null doc_id is held out of nothing (held_out false)."""
    return identified(docs, fit(docs, folds, held_out)).select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
