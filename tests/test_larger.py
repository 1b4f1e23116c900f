"""Faults that showed on larger tables, each by a small one that has its cause."""

import datetime
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from feedmill.operators import dedupe, identity, overlap
from feedmill.plans.identity import PARTS
from feedmill.plans.queries import ORACLE_SQL, QUERIES


def agrees(spark, folder, name, **tables):
    """Whether a query agrees with its SQL over the given tables."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = QUERIES[name](spark, str(folder))
    rel = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in found.columns]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_days_whose_highest_value_is_zero(spark, tmp_path):
    at = lambda day: datetime.datetime(2024, 1, day, 12)
    rows = [(1, at(1), 5.0), (1, at(2), 0.0), (1, at(3), 0.0), (1, at(4), 3.0), (2, at(1), -1.0), (2, at(2), 0.0), (2, at(3), None), (3, at(6), 0.0), (3, at(7), 0.0)]
    agrees(spark, tmp_path, "deltas", events=spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double"))


def stored(frame, path):
    """frame as a table on disk, by whose files Spark judges what it may broadcast."""
    frame.write.parquet(str(path))
    return frame.sparkSession.read.parquet(str(path))


def test_matches_of_events_broadcast_no_sets_of_pieces(spark, tmp_path):
    shape = "title string, url string, anchors array<string>, tags array<string>"
    rows = [("small bolt of 5 years", "u1", ["bolt", "#5years"], ["x"]), ("small bolt of 5 years", "u2", ["bolt", "#5years"], ["x"]), (None, "u2", [], []), ("plate", "", ["plate"], []), (None, None, [], [])]
    told = [("e3", "small bolt of 5 years", "", ["#5years", "bolt"], ["x"]), ("e2", "another", "u2", ["rod"], []), ("e4", "", "u2", [], []), ("e5", None, None, [], [])]
    candidates = stored(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {shape}"), tmp_path / "candidates")
    out = identity.best_match(candidates, stored(spark.createDataFrame(told, f"event_id string, {shape}"), tmp_path / "told"), PARTS)
    assert "Broadcast" not in plan(out)
    assert {r.id: (r.event_id, r.similarity) for r in out.collect()} == {0: ("e3", 1.0), 1: ("e2", 1.0), 2: ("e2", 1.0)}


def test_novelty_joins_texts_without_a_broadcast(spark):
    found = plan(QUERIES["event_novelty"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in found and "Broadcast" not in found


def pieces(title):
    t = "".join(c for c in title.lower() if c.isalnum())
    return {t} - {""} if len(t) < 2 else {t[i : i + 2] for i in range(len(t) - 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def addresses(n, seed=5, numbers=999):
    """Addresses of few hosts, most of whose pieces all of them have."""
    rng = random.Random(seed)
    hosts = [f"{rng.choice(['www', 'm', 'blog'])}.th{a}{b}.example.{rng.choice(['com', 'net', 'org'])}" for a in ("th", "er", "ea") for b in ("st", "on", "ing")]
    return [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de'])}/{rng.randint(1, numbers)}{rng.choice(['', '/', '.html', '#top'])}" for _ in range(n)]


@pytest.mark.parametrize("joined", [0, 1e12])
@pytest.mark.parametrize("measure, threshold", [("jaccard", 0.7), ("dice", 0.6)])
def test_both_ways_to_similar_pairs_match_brute_force(spark, monkeypatch, joined, measure, threshold):
    monkeypatch.setattr(dedupe, "AT_ONCE", -1)
    monkeypatch.setattr(dedupe, "JOINED", joined)
    monkeypatch.setattr(overlap, "PIECES", 900)  # some blocks
    titles = [*addresses(150), "", "", "a", "a"]
    frame = spark.createDataFrame(list(enumerate(titles)), "id int, title string").select(F.col("id"), dedupe.title_bigrams(F.col("title")).alias("grams"))
    sets = [pieces(t) for t in titles]
    score = lambda i, j: 0.0 if not sets[i] | sets[j] else jaccard(sets[i], sets[j]) if measure == "jaccard" else 2 * len(sets[i] & sets[j]) / (len(sets[i]) + len(sets[j]))
    want = {(i, j): score(i, j) for i in range(len(titles)) for j in range(i) if score(i, j) >= threshold}
    got = {(r.v, r.u): r.score for r in dedupe.similar_pairs(frame, None, threshold, measure).collect()}
    assert got == want
    two = dedupe.similar_pairs(frame.where("id % 3 = 0"), frame.where("id % 3 > 0"), threshold, measure).collect()
    assert {(r.u, r.v): r.score for r in two} == {(i, j): score(i, j) for i in range(0, len(titles), 3) for j in range(len(titles)) if j % 3 and score(i, j) >= threshold}
    left = dedupe.not_in_history(spark.createDataFrame([(i, t) for i, t in enumerate(titles) if i % 3], "pos int, title string"), spark.createDataFrame([(t,) for t in titles[::3]], "title string"), 0.75)
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a | b else 0.0
    assert {r.pos for r in left.collect()} == {i for i in range(len(titles)) if i % 3 and not any(dice(sets[i], s) >= 0.75 for s in sets[::3])}


@pytest.mark.parametrize("chunk", [5, 40, 4_096])
def test_clusters_of_many_like_titles_match_a_scan(spark, chunk):
    rng = random.Random(3)
    titles = [t if rng.random() > 0.03 else "--" for t in addresses(300)] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(100)]
    rng.shuffle(titles)
    links = [f"l{rng.randint(0, 30)}" if rng.random() < 0.1 else rng.choice(["", None]) for _ in titles]
    leaders, want = [], {}
    for pos, (title, link) in enumerate(zip(titles, links, strict=True)):
        want[pos] = next((p for p, g, other in leaders if (link and link == other) or jaccard(pieces(title), g) >= 0.7), pos)
        if want[pos] == pos:
            leaders.append((pos, pieces(title), link))
    frame = spark.createDataFrame([(p, t, u) for p, (t, u) in enumerate(zip(titles, links, strict=True))], "pos int, title string, url string")
    out = dedupe.title_clusters(frame, 0.7, F.col("url"), chunk)
    assert dict(out.dtypes)["leader"] == "int"
    assert {r.pos: r.leader for r in out.collect()} == want


@pytest.mark.parametrize("name", ["near_dup_pairs", "dedupe_greedy", "dedupe_vs_history"])
def test_pages_of_few_hosts_take_seconds(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(addresses(12_000, numbers=99_999))), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    began = time.time()
    QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 60  # the join over pieces took more than that


def test_names_of_many_suppliers_take_seconds(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"Supplier#{i:09d}", rng.randint(0, 24)) for i in range(40_000)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    began = time.time()
    got = {(int(r.key), int(r.detail)) for r in QUERIES["alike_names"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 60  # the join over pieces took more than that
    sets = [pieces(f"{name}{nation}") for _, name, nation in rows]
    assert all(jaccard(sets[u], sets[v]) > 0.85 for u, v in rng.sample(sorted(got), 500))
    for u in rng.sample(range(len(rows)), 20):
        assert {v for v in range(len(rows)) if v != u and jaccard(sets[u], sets[v]) > 0.85} == {b if a == u else a for a, b in got if u in (a, b)}


@pytest.mark.parametrize("chunk", [3, 20, 4_096])
def test_sections_match_a_scan(spark, chunk):
    rng = random.Random(chunk)
    anchors = ["bolt", "ring", "rod", "red", "blue", "Brand#1", "3 years", "5 years", "8 years"]
    rows = [(p, " ".join(rng.sample(anchors, rng.randint(0, 3))), rng.choice([None, "", f"l{rng.randint(0, 40)}", f"m{rng.randint(0, 400)}"])) for p in range(160)]
    rows += [(p, rng.choice(["bolt 3 years", "rod 5 years", "red 8 years"]), f"n{p}") for p in range(160, 400)]
    sets = lambda t: {a for a in ("bolt", "ring", "rod", "red", "blue", "Brand#1") if a in t} | {f"#{n}years" for n in "358" if f"{n} years" in t}
    same = lambda a, b: len(a & b) >= 2 and any(not x.startswith("#") and x not in PARTS.generic for x in a & b)
    kept = []
    for p, title, url in rows:
        if not any((url and url == other) or same(sets(title), fp) for _, fp, other in kept):
            kept.append((p, sets(title), url))
    out = identity.dedupe_sections(spark.createDataFrame(rows, "pos long, title string, url string"), PARTS, chunk)
    assert sorted(r.pos for r in out.collect()) == [p for p, _, _ in kept]


def test_suppliers_of_few_links_take_seconds(spark, tmp_path):
    spark.range(60_000).select(F.col("id").alias("s_suppkey"), (F.xxhash64("id") % 25 + 25).cast("int").alias("s_nationkey")).withColumn("s_nationkey", F.col("s_nationkey") % 25).write.parquet(f"{tmp_path}/supplier.parquet")
    began = time.time()
    assert QUERIES["dedupe_sections_by_link"](spark, str(tmp_path)).count() > 0
    assert time.time() - began < 60  # pairs of rows of one link took more than that
