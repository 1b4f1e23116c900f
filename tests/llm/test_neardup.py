import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from feedmill.llm import common, neardup_embeddings, simhash


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_gray_index_finds_each_pair_once(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    fps = np.concatenate([base, near, near[:60] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)), base[:5]])
    found = [(min(i, j), max(i, j), d) for a, b, c in simhash.GrayIndex(fps).pairs(radius) for i, j, d in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)]
    far = np.bitwise_count(fps[:, None] ^ fps[None])
    assert len(found) == len(set(found))
    assert set(found) == {(i, j, int(far[i, j])) for i in range(len(fps)) for j in range(i + 1, len(fps)) if far[i, j] <= radius}


def test_gray_index_over_several_lanes_and_small_frontiers(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, (90, 3), dtype=np.uint64)
    fps[40:60] = fps[:20] ^ (np.uint64(1) << rng.integers(0, 64, (20, 3)).astype(np.uint64))
    found = {(min(i, j), max(i, j)) for a, b, _ in simhash.GrayIndex(fps).pairs(4) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    assert found == {(i, j) for i in range(90) for j in range(i + 1, 90) if far[i, j] <= 4}


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


TEXTS = [None, "", "  \n", "One", "one", "a b", "A b c d e f g", "a b c d e f h", "é É b \x0b c", "x" * 5000 + " " + "y z " * 3000, "to be or not to be " * 4]


def test_fingerprints_match_brute_force():
    for text in TEXTS:
        assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) == brute_fingerprint(text, 3)


def test_simhash_query_contract(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    long = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(12)]
    texts = TEXTS + long + [t.replace("w1 ", "w2 ", 1) for t in long] + [t + " end" for t in long[:6]] + long[:3]
    rows = [(i + 10, t, "en", 7) for i, t in enumerate(texts)] + [(11, "", "x", 8), (None, "One", "x", 8), (None, "alone", "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    prints = [brute_fingerprint(t, 3) for _, t, *_ in rows]
    ids = [r[0] for r in rows]
    known = [k for k, i in enumerate(ids) if i is not None]
    want = brute_components(sorted({ids[k] for k in known}), [(ids[a], ids[b]) for a in known for b in known if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2])
    by_print = {p: want[i] for p, i in zip(prints, ids, strict=True) if i is not None}
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == sorted((str(i), f"{p:016x}", str(by_print.get(p))) for i, p in zip(ids, prints, strict=True))


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 8)  # so that hot buckets are split here too
    monkeypatch.setattr(simhash, "BUCKET", 64)
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(60, 300))] for _ in range(25)]
    texts = []
    for words in base:
        for edits in (0, 0, 1, 2):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (None, texts[0]), (3, texts[3])]
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows if i is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and (not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)]
    want = brute_components(list(sets), pairs)
    out = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted((i, want[i]) for i, _ in rows if i is not None)


def brute_groups(rows):
    """component of each id: groups of texts whose sets of five-word shingles are alike by 0.8 or more."""
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    holders = {}
    for i, found in sets.items():
        for x in found:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    return brute_components(list(sets), [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def groups_of(spark, rows):
    return {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_similar_groups_measure_sets_of_shingles(spark):
    rng = random.Random(5)
    prose = [" ".join(f"{name}{rng.randrange(10**6)}" for _ in range(n)) for name, n in (("a", 60), ("b", 200), ("c", 300), ("d", 300), ("e", 300))]
    line = "this one line of eleven words stands fifty times in both "
    rows = [(1, line * 50 + prose[0]), (2, line * 50 + prose[1]), (3, "word " * 1000 + prose[2]), (4, "word " * 1000 + prose[3]), (5, prose[4] + " left" * 900), (6, prose[4] + " right" * 900)]
    want = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    assert brute_groups(rows) == want
    assert groups_of(spark, rows) == want


def test_similar_groups_compare_all_of_a_group(spark):
    rng = random.Random(8)
    base = [f"v{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(2, 6)):
            copy[at] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    want = brute_groups(rows)
    assert 20 < len(set(want.values())) < 80
    assert groups_of(spark, rows) == want


def test_similar_groups_lose_none_of_many_documents(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(900):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(60, 120))]
        cut = round(len(words) * rng.uniform(0.1, 0.13))
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-cut] + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, cut // 2))]))]
    want = brute_groups(rows)
    assert 300 < sum(i != c for i, c in want.items())
    assert groups_of(spark, rows) == want


def test_fingerprints_link_near_copies_and_sets_confirm_them(spark, monkeypatch):
    rng = random.Random(12)
    base = [[f"v{rng.randrange(10**6)}" for _ in range(900)] for _ in range(12)]
    texts = [" ".join(words) for words in base] + [" ".join([*words[:-1], "edited"]) for words in base]
    line = "this one line of eleven words stands fifty times in both "
    texts += [line * 50 + " ".join(base[0][:60]), line * 50 + " ".join(base[1][:60])]
    rows = list(enumerate(texts))
    fps = [simhash.fingerprint(simhash.shingle_hashes(t, 3)) for t in texts]
    near = [(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert (24, 25) in near and len(near) > 6
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    want = brute_components(list(range(len(texts))), [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert want[25] == 25
    whole = brute_groups(rows)
    assert groups_of(spark, rows) == whole
    monkeypatch.setattr(simhash, "_rare_shared", lambda once, *_: once.select(F.col("uid").alias("u"), F.col("uid").alias("v")))  # no way for the rest
    assert groups_of(spark, rows) == want


def test_what_fingerprints_linked_is_not_compared_again():
    sets = [np.arange(100, dtype=np.uint64) + k for k in range(4)]
    assert len(simhash.similar_forest(sets, None, 0.8)) == 3
    assert len(simhash.similar_forest(sets, None, 0.8, np.array([7, 7, 9, 9]))) == 1
    assert simhash.similar_forest(sets, None, 0.8, np.array([7, 7, 7, 7])) == []


def test_local_roots():
    assert common.local_roots(6, np.array([5, 3, 4]), np.array([4, 2, 1])).tolist() == [0, 1, 2, 2, 1, 1]


def brute_links(rows, threshold=0.9):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v in rows]
    return [(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= threshold]


@pytest.mark.parametrize("piece", [1024, 6])
def test_embeddings_match_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(neardup_embeddings, "PIECE", piece)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    near = np.concatenate([base[i % 5] + rng.normal(size=16) * 0.15 for i in range(50)]).reshape(50, 16)
    vectors = [list(map(float, v)) for v in np.concatenate([base, near, base[:4], base[:2] * 3])]
    vectors += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e300, 1e300], [1e-300, 1e-300]]
    rows = [(i * 3 + 1, v) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, uid string")
    links = brute_links(rows)
    degree = {i: 0 for i, _ in rows}
    for a, _ in links:
        degree[rows[a][0]] += 1
    component = brute_components([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    out = neardup_embeddings.near_duplicates(frame).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == sorted((i, degree[i], component[i], component[i] == i) for i, _ in rows)


def test_embeddings_empty_null_ids_and_recall(spark):
    schema = "vec_id long, embedding array<float>"
    assert neardup_embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    out = neardup_embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.1]), (None, [0.0, 1.0]), (5, [1.0, 0.1])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in out) == [("5", 2, "5", True), ("5", 2, "5", True), ("None", 0, "None", False), ("None", 2, "5", False)]


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(0)
    dim = 64
    coder = neardup_embeddings.Codes(dim, 4, 8)
    a = rng.normal(size=(2000, dim))
    b = a + rng.normal(size=a.shape) * 0.35
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    _, signs, factor, _ = coder(a)
    rotated = coder(b)[0]
    true = (a * b).sum(axis=1)
    guess = (signs * rotated).sum(axis=1) / (np.sqrt(dim) * factor)
    assert abs((guess - true).mean()) < 0.01
    near = true >= 0.9
    assert near.sum() > 500 and (guess[near] >= 0.9 - neardup_embeddings.margin(factor[near], dim, 0.9)).mean() > 0.999


def test_rows_without_an_id_bridge_others(spark):
    base = [0xFFFF_0000_1234_5678, 0xFFFF_0000_1234_567B, 0xFFFF_0000_1234_5677 ^ 0x3F000000]
    chain = [base[0], base[0] ^ 0b11, base[0] ^ 0b1111, base[0] ^ 0b111111]
    edges = {tuple(r) for r in simhash.links(spark.createDataFrame([(x - 2**64,) for x in chain], "fp long")).collect()}
    assert len(edges) == 3
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(5, words), (None, words), (9, words)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.component_id for r in out] == [5, 5, 5]


def test_hot_groups_are_searched_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    low = rng.integers(0, 1 << 32, 300, dtype=np.uint64)
    low = np.unique(np.concatenate([low, low[:60] ^ np.uint64(1), low[60:90] ^ np.uint64(6)])).astype(np.int64)
    frame = spark.createDataFrame([(int(x),) for x in low], "fp long")
    far = np.bitwise_count((low[:, None] ^ low[None, :]).view(np.uint64))
    monkeypatch.setattr(simhash, "PIECE", 40)
    edges = [tuple(r) for r in simhash.links(frame).collect()]
    place = {int(x): i for i, x in enumerate(low)}
    i, j = np.nonzero((far <= 2) & (far > 0))
    want = common.local_roots(len(low), i, j)
    got = common.local_roots(len(low), np.array([place[u] for u, _ in edges]), np.array([place[v] for _, v in edges]))
    assert (want == got).all()


def test_groups_of_a_sorted_partition_stay_whole():
    import pyarrow as pa

    groups = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    table = pa.table({"g": groups, "h": [0] * len(groups), "x": list(range(len(groups)))})
    for size in (1, 2, 3, 4, 11):
        batches = table.to_batches(max_chunksize=size)
        empty = table.slice(0, 0).to_batches() or [pa.RecordBatch.from_pylist([], schema=table.schema)]
        got = [t["x"].to_pylist() for t in common.whole_groups(iter([*empty, *batches, *empty]), ["g", "h"])]
        assert got == [[0, 1], [2], [3, 4, 5, 6, 7], [8], [9, 10]]
    assert list(common.whole_groups(iter([]), ["g"])) == []


def test_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.9005, 0.92, size=(len(base), 1))
    both = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * aside])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    found = neardup_embeddings.near_duplicates(frame).where("n_links > 0").count()
    assert found / len(both) >= 0.995


def test_embedding_ids_of_any_size_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    a, b, c, d = rng.normal(size=(4, 16))
    low = -(2**63) + 5
    rows = [(low, a), (7, a * 1.01 + 0.001), (1, b), (9, b + 0.001), (1, c), (10, c + 0.001), (11, c - 0.001), (None, d), (-(2**61), d), (None, rng.normal(size=16))]
    out = neardup_embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    got = sorted((tuple(r) for r in out), key=repr)
    assert got == sorted([(low, 1, low, True), (7, 1, low, False), (1, 1, 1, True), (9, 1, 1, False), (1, 2, 1, True), (10, 2, 1, False), (11, 2, 1, False), (None, 1, -(2**61), False), (-(2**61), 1, -(2**61), True), (None, 0, None, False)], key=repr)
