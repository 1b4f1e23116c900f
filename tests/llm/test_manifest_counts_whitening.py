import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedmill.llm import merkle, queries, tokencount, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of rows (doc_id, text, lang, source, n_chars)."""

    def tree(nodes):
        """Root, and for each node the siblings (before, after) on its way."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for leaf, place in enumerate(at):
                first = place // 8 * 8
                ways[leaf].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 8])))
            nodes = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
            at = [place // 8 for place in at]
        return nodes[0], ways

    trees = {}
    for r in rows:
        low = None if r[1] is None else "".join(c.lower() if c in merkle._UPPER else c for c in r[1])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        head = [framed(r[0]), framed(r[3]), framed(r[2]), framed(r[4])]
        leaf = digest(*head, framed(r[1]))
        trees.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(((r[0] is not None, r[0] or 0, leaf), r[0], leaf, digest(*head, framed(low)) if hit else leaf))
    names = sorted(trees)
    found = {name: tree([x[2] for x in sorted(trees[name], key=lambda x: x[0])]) for name in names}
    root, upper = tree([found[name][0] for name in names]) if names else (None, [])
    out = []
    for name, above in zip(names, upper, strict=True):
        for (_, doc_id, leaf, start), way in zip(sorted(trees[name], key=lambda x: x[0]), found[name][1], strict=True):
            cur = start
            for before, after in way + above:
                cur = digest(before, cur, after)
            out.append((doc_id, leaf, found[name][0], root, digest(*[a + b for a, b in way + above]), cur, cur == root))
    return sorted(out, key=repr)


def manifest_rows(frame):
    got = merkle.manifest(frame, F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.tampered_text(F.col("text"))))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_manifest_matches_brute_force_with_nulls_ties_and_repeats(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(-5, 700)]), rng.choice([None, "", "Ab é", "x" * 50, "ÀB"]), rng.choice([None, "", "=", "de", "de", "de", "en"]), rng.choice([None, "s"]), rng.choice([None, 7])) for _ in range(1500)]
    rows += [rows[3]] * 40 + [(9, "a", f"once-{i}", "s", 1) for i in range(70)]
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)
    assert manifest_rows(frame) == brute_manifest(rows)


def test_manifest_of_several_blocks(spark):
    rows = [(i, f"T {i}", "de" if i % 11 else None, "s", i) for i in range(2 * merkle.BLOCK + 77)]
    got = manifest_rows(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))
    assert got == brute_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(rows)


def test_manifest_of_one_leaf_and_of_nothing(spark):
    one = [(4, None, None, None, None)]
    got = manifest_rows(spark.createDataFrame([(*one[0], "", 0)], SCHEMA))
    assert got == brute_manifest(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == hashlib.sha256(b"").hexdigest()
    assert manifest_rows(spark.createDataFrame([], SCHEMA)) == []


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.COUNTED)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_match_the_library(spark, library):
    rng = random.Random(2)
    pieces = ["a", "the", " ", "  ", "\n", "é", "日本", "½", "😀", "'s", "'ll", "12", "!", "\x1c", "\x85", " ", "ing", "\t", "<|endoftext|>", "<|endof", "text|>", "ſ", "Ⅷ", "é", "​", "࠰", "𐐀"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD000), rng.randint(0x1F000, 0x1FFFF)])) for _ in range(12)) for _ in range(500)]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    got = tokencount.counted(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), queries.COUNTED).collect()
    assert {r.doc_id: r.n_tokens for r in got} == dict(enumerate(expected(library, texts)))
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512) for r in got)


def test_token_counts_of_edges_and_of_a_long_tail(spark, library, monkeypatch):
    monkeypatch.setattr(tokencount, "FREQUENT", 3)  # all but the most frequent pre-tokens go by shuffle
    texts = [None, "", "word " * 60_000, "x" * 5_000, "a b c", "a b c", "a b <|endoftext|> <|endoftext|>", " " * 1000]
    rows = [(1 if i == 5 else None if i == 6 else i, t, "p") for i, t in enumerate(texts)]
    got = tokencount.counted(spark.createDataFrame(rows, "doc_id long, text string, piece string"), queries.COUNTED).collect()
    want = [(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, expected(library, [t or "" for t in texts]), strict=True)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert tokencount.counted(spark.createDataFrame([], "doc_id long, text string"), queries.COUNTED).count() == 0


def test_token_counts_of_a_lower_casing_tokenizer(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello WORLD, it's", "  Ünï  code 12", "", "<|startoftext|>a"]
    try:
        got = tokencount.counted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    except ValueError:
        pytest.skip("its added tokens take in neighbours")
    assert {r.doc_id: r.n_tokens for r in got} == dict(enumerate(expected(Tokenizer.from_file(path), texts)))


def test_whole_texts_of_the_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op12_token_counts(spark, DATA).collect()}
    assert got == dict(zip(docs, expected(library, list(docs.values())), strict=True))


@pytest.mark.parametrize("d", [1, 2, 3, 7, 24, 65])
def test_jacobi_finds_what_the_library_finds(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, 3 * d))
    a = np.diag(10.0 ** rng.integers(-5, 5, d)) @ (a @ a.T) @ np.diag(np.ones(d))
    a = (a + a.T) / 2
    values, vectors = whitening.jacobi(a)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * np.abs(values).max())
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * np.abs(values).max())


def test_jacobi_is_accurate_in_small_eigenvalues():
    scale = np.diag(10.0 ** np.arange(0, -9, -1.0))
    inner = np.eye(9) + 0.1
    values, _ = whitening.jacobi(scale @ inner @ scale)
    det = np.linalg.det(inner) * np.prod(np.diag(scale)) ** 2  # the product of all eigenvalues
    assert abs(np.prod(values) / det - 1) < 1e-9


def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    centred = x - x.mean(axis=0)
    values, w = np.linalg.eigh(centred.T @ centred / n)
    values, w = values[::-1], w[:, ::-1]
    return [sum((n * int(e) - t) ** 2 for e, t in zip(r, s, strict=True)) for r in x], centred @ w / np.sqrt(values), values / values.sum()


def test_whitening_matches_brute_force(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    fit = [(i, e) for i, e in table if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    deviation, white, share = brute_whitening([e for _, e in fit])
    out = queries.op13_whitening(spark, DATA).toPandas()
    assert len(out) == 32 * len(fit) and (out.n == len(fit)).all() and out.identity_error.max() < 1e-9
    assert dict(zip(out.vec_id, out.deviation, strict=True)) == {i: d for (i, _), d in zip(fit, deviation, strict=True)}
    for component, rows in out.groupby("component"):
        got = rows.set_index("vec_id").whitened.loc[[i for i, _ in fit]].to_numpy()
        want = white[:, component - 1]
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert np.allclose(rows.explained, share[component - 1], rtol=1e-9)


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (3, [0.5, 0.25]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [3e38, 1.0]), (9, []), (10, [1.0, 2.0, 5.0]), (11, [2.0, 2.0, 5.0])]
    out = whitening.whitened(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, x int, size int")).collect()
    pairs = [r for r in out if r.vec_id in (1, None, 3)]
    assert len(out) == 4 * 2 + 2 * 3 and {r.n for r in pairs} == {4} and {r.n for r in out} == {4, 2}
    deviation, white, _ = brute_whitening([v for _, v in rows[:4]])
    assert sorted(r.deviation for r in pairs) == sorted(deviation * 2)
    assert np.allclose(sorted(abs(r.whitened) for r in pairs), sorted(np.abs(white).ravel()), atol=1e-9)
    assert {(r.component, r.whitened is None, r.explained) for r in out if r.n == 2} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}


def test_whitening_without_variance_and_of_large_entries(spark):
    schema = "vec_id long, embedding array<double>"
    same = whitening.whitened(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], schema)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in same)
    wide = whitening.whitened(spark.createDataFrame([(1, [1e15]), (2, [0.0]), (3, [2e6])], schema)).collect()
    assert {r.vec_id: r.deviation for r in wide}[1] is None
    x = [64 * 10**7, 0, 64 * 2 * 10**6]
    near = whitening.whitened(spark.createDataFrame([(1, [1e7]), (2, [0.0]), (3, [2e6])], schema)).collect()
    assert {r.vec_id: r.deviation for r in near} == {i + 1: (3 * v - sum(x)) ** 2 for i, v in enumerate(x)}
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
