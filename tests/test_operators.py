import random

import pytest
from pyspark.sql import functions as F

from feedmill.functions.text import title_bigrams
from feedmill.operators import components, dedupe, indicators, joins, memory, merge, normalize, ranking, rules, scoring, topics, usage


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2040)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    out = {r.id: r.component_id for r in components.components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert out == {i: find(i) for e in edges if e[0] != e[1] for i in e}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_leaders(rows, threshold):
    def grams(s):
        t = "".join(c for c in (s or "").lower() if c.isalnum())
        return {t} - {""} if len(t) < 2 else {t[i : i + 2] for i in range(len(t) - 1)}

    leaders, out = [], {}
    for pos, title, link in rows:
        for lead, other, url in leaders:
            g, h = grams(title), grams(other)
            if (link and link == url) or (len(g & h) / len(g | h) if g | h else 1) >= threshold:
                out[pos] = lead
                break
        else:
            leaders.append((pos, title, link))
            out[pos] = pos
    return out


def test_greedy_clusters_match_a_scan(spark):
    rng = random.Random(8)
    words = ["rates", "cut", "bank", "loan", "rise", "fall", "gold", "price"]
    rows = []
    for pos in range(120):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) if rng.random() < 0.9 else rng.choice(["", "!!", None, "a"])
        rows.append((pos, title, f"http://h/{rng.randint(0, 200)}"))
    frame = spark.createDataFrame(rows, "pos long, title string, url string")
    out = dedupe.title_clusters(frame, 0.7, F.col("url"))
    assert {r.pos: r.leader for r in out.collect()} == brute_leaders(rows, 0.7)
    kept = dedupe.keep_per_theme(out, F.pmod("pos", F.lit(2)), F.col("pos")).collect()
    assert all(sum(1 for r in kept if r.leader == k.leader) <= 2 for k in kept)


def test_history_and_nearest_titles(spark):
    rows = spark.createDataFrame([(1, "bank cuts the rates"), (2, "gold price falls"), (3, None)], "pos long, title string")
    assert {r.pos for r in dedupe.not_in_history(rows, spark.createDataFrame([("Bank cuts rates",)], "title string")).collect()} == {2, 3}
    near = dedupe.nearest_titles(rows.select(F.col("pos").alias("id"), "title"), rows.select(F.col("pos").alias("id"), "title"), top=1).collect()
    assert {(r.id, r.other) for r in near} == {(1, 1), (2, 2)}


def test_quotas_match_loops(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.randint(0, 50)) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, source string, score int")
    order = [F.desc("score"), "id"]
    by_score = sorted(rows, key=lambda r: (-r[2], r[0]))
    used, want = {}, []
    for r in by_score:
        if len(want) < 30 and used.get(r[1], 0) < 12:
            used[r[1]] = used.get(r[1], 0) + 1
            want.append(r[0])
    assert {r.id for r in ranking.interleaved_quota(frame, "source", order, 12, 30).collect()} == set(want)
    used, want = {}, set()
    for r in by_score[:30]:
        used[r[1]] = used.get(r[1], 0) + 1
        if used[r[1]] <= 5:
            want.add(r[0])
    assert {r.id for r in ranking.top_then_quota(frame, "source", order, 30, 5).collect()} == want


def test_floor_and_next_unused(spark):
    frame = spark.createDataFrame([(1, "a", 5), (2, "b", 9), (3, "b", 7), (4, "b", 1)], "id int, section string, score int")
    out = {r.id: r.section for r in ranking.floor_refill(frame, "section", "a", F.col("score") > 2, [F.desc("score"), "id"], 3).collect()}
    assert out == {1: "a", 2: "a", 3: "a", 4: "b"}
    assert spark.range(1).select(ranking.next_unused(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("x")))).first()[0] == "y"


def test_floor_and_level_with_nulls_and_repeated_rows(spark):
    schema = "id int, section string, score int, note string"
    rows = [(1, "a", 5, None), (2, "b", 9, None), (2, "b", 9, None), (3, "b", 7, "x"), (4, None, 8, None)]
    out = sorted((r.id, str(r.section)) for r in ranking.floor_refill(spark.createDataFrame(rows, schema), "section", "a", F.col("score") > 2, [F.desc("score"), "id"], 3).collect())
    assert out == [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, "None")]
    rows = [(1, "a", 3, None), (1, "a", 3, None), (2, "b", 3, None), (3, "b", None, None), (4, "c", 1, "x"), (5, None, 3, None)]
    frame = spark.createDataFrame(rows, "id int, section string, importance int, note string")
    out = sorted((r.id, str(r.section), str(r.importance)) for r in ranking.limit_level(frame, "section", ["id"], 3, 1, 2).collect())
    assert out == [(1, "a", "2"), (1, "a", "3"), (2, "b", "3"), (3, "b", "None"), (4, "c", "1"), (5, "None", "2")]


def test_greedy_clusters_match_a_scan(spark):
    import random

    rng = random.Random(4)
    titles = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    links = [rng.choice([None, "", "l1", "l2", f"x{i}"]) for i in range(120)]
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or ({s} if s else set())
    like = lambda a, b: len(grams(a) & grams(b)) >= 0.7 * len(grams(a) | grams(b))
    leaders, want = [], {}
    for i, title in enumerate(titles):
        found = [j for j in leaders if like(title, titles[j]) or (links[i] and links[i] == links[j])]
        want[i] = found[0] if found else i
        if not found:
            leaders.append(i)
    frame = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(titles, links, strict=True))], "pos long, title string, url string")
    got = {r.pos: r.leader for r in dedupe.title_clusters(frame, 0.7, F.col("url")).collect()}
    assert got == want


def test_merges(spark):
    schema = "url string, title string, at int"
    old, new = spark.createDataFrame([("a", "old", 1), ("b", "old", 5)], schema), spark.createDataFrame([("a", "new", 1), ("b", "new", 4), ("c", "new", None)], schema)
    assert {(r.url, r.title) for r in merge.latest_wins(old, new, "url", "at").collect()} == {("a", "new"), ("b", "old"), ("c", "new")}
    rolled = merge.fill_by_precedence(new.withColumn("title", F.lit(None).cast("string")), old, "url", ["title"]).collect()
    assert {(r.url, r.title, r.at, r.fetched_today) for r in rolled} == {("a", "old", 1, True), ("b", "old", 4, True), ("c", None, None, True)}
    diff = {(r.url, r.type, r.field, r["from"], r.to) for r in merge.snapshot_diff(old, new, "url", ["title", "at"]).collect()}
    assert diff == {("a", "changed", "title", "old", "new"), ("b", "changed", "title", "old", "new"), ("b", "changed", "at", "5", "4"), ("c", "added", None, None, None)}
    assert {r.url: r.title for r in merge.priority_union([new, old], "url", []).collect()} == {"a": "new", "b": "new", "c": "new"}
    arrays = merge.union_arrays(spark.createDataFrame([("k", ["b"])], "k string, d array<string>"), spark.createDataFrame([("k", ["a", "b"]), ("m", ["z"])], "k string, d array<string>"), "k", "d")
    assert {r.k: r.d for r in arrays.collect()} == {"k": ["a", "b"], "m": ["z"]}


def test_as_of_and_cascade(spark):
    left = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), ("m", 5, "z")], "k string, at int, name string")
    right = spark.createDataFrame([("k", 2, 20.0), ("k", 5, 50.0), ("k", 6, 60.0)], "k string, at int, price double")
    assert {(r.name, r.price) for r in joins.as_of(left, right, "k", "at", ["price"]).collect()} == {("x", 50.0), ("y", None), ("z", None)}
    rows = spark.createDataFrame([(1, "a", "n"), (2, None, "m")], "id int, code string, name string")
    out = joins.cascade(rows, [(spark.createDataFrame([("a", "by code")], "code string, v string"), "code"), (spark.createDataFrame([("n", "by name"), ("m", "by name")], "name string, v string"), "name")], "v")
    assert {r.id: r.v for r in out.collect()} == {1: "by code", 2: "by name"}


def prices():
    rng = random.Random(4)
    return [100 + rng.uniform(-5, 5) + i * 0.1 for i in range(80)]


def ema_list(values, n):
    out = [sum(values[:n]) / n]
    for x in values[n:]:
        out.append((x - out[-1]) * 2 / (n + 1) + out[-1])
    return out


def test_indicators_match_loops(spark):
    close = prices()
    frame = spark.createDataFrame([(s, i, c if s == "a" else 7.0) for s in "ab" for i, c in enumerate(close)], "symbol string, i int, close double").withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")))
    last = lambda f, c: {r.symbol: r[c] for r in f.groupBy("symbol").agg(F.max_by(c, "d").alias(c)).collect()}
    gain = loss = 0.0
    diffs = [b - a for a, b in zip(close, close[1:], strict=False)]
    gain, loss = sum(max(x, 0) for x in diffs[:14]) / 14, sum(max(-x, 0) for x in diffs[:14]) / 14
    for x in diffs[14:]:
        gain, loss = (gain * 13 + max(x, 0)) / 14, (loss * 13 + max(-x, 0)) / 14
    out = last(indicators.rsi(frame), "rsi")
    assert out["a"] == pytest.approx(100 - 100 / (1 + gain / loss)) and out["b"] == pytest.approx(0.0)
    fast, slow = ema_list(close, 12), ema_list(close, 26)
    line = [a - b for a, b in zip(fast[-len(slow) :], slow, strict=True)]
    assert last(indicators.macd(frame), "signal")["a"] == pytest.approx(ema_list(line, 9)[-1])
    assert last(indicators.sma(frame, "close", 20), "sma")["a"] == pytest.approx(sum(close[-20:]) / 20)
    value = spark.createDataFrame([(close,)], "c array<double>").select(indicators.last_ema(F.col("c"), 12)).first()[0]
    assert value == pytest.approx(fast[-1]) and last(indicators.ema(frame, 12), "ema")["a"] == pytest.approx(fast[-1])
    crossed = indicators.crosses(frame.withColumn("level", F.lit(104.0)), "close", "level").where("symbol = 'a'").orderBy("i").collect()
    want = [(i, "up" if close[i] > 104 else "down") for i in range(1, 80) if (close[i - 1] - 104) * (close[i] - 104) < 0]
    assert [(r.i, r.direction) for r in crossed] == want
    recent = indicators.recent_cross(frame.withColumn("level", F.lit(104.0)), "close", "level", 80).where("symbol = 'a'").first()
    assert (79 - want[-1][0], want[-1][1]) == (recent.days_ago, recent.direction)


def test_topics(spark):
    rows = [(i, f"2024-01-0{1 + i % 3}", "news", ["rare" if i < 4 else "noise%d" % i, "wide"], f"t{i}", "s", 1 + i % 3) for i in range(12)]
    items = spark.createDataFrame(rows, "id int, date string, section string, tags array<string>, title string, summary string, importance int").withColumn("date", F.to_date("date"))
    items = items.withColumn("section", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    nodes = topics.dedupe_items(items.unionByName(items.where("id = 0").withColumn("date", F.to_date(F.lit("2024-01-09")))))
    first = nodes.where("id = 0").first()
    assert first.repeat == 2 and len(first.seen_dates) == 2
    labels = spark.createDataFrame([("rare", "Rare"), ("wide", "Wide")], "tag string, label string")
    out = topics.topics(nodes, labels, F.to_date(F.lit("2024-01-10"))).collect()
    assert [(r.tag, r.n_items, r.n_dates, r.span_days, r.active, r.dormant) for r in out] == [("rare", 4, 4, 9, True, False)]
    assert topics.related_tags(nodes, labels, rare=1.1).collect()[0].related == "wide"


def test_memory(spark):
    today = F.to_date(F.lit("2024-01-10"))
    frame = spark.createDataFrame([("2024-01-09 17:00:00", "2024-01-01 00:00:00"), ("2024-02-01 00:00:00", "2024-01-10 00:00:00"), ("2024-01-01 00:00:00", "2024-01-10 00:00:00"), (None, "2024-01-10 00:00:00")], "p string, s string")
    assert [r[0] for r in frame.select(memory.is_fresh(F.col("p").cast("timestamp"), F.col("s").cast("timestamp"), today)).collect()] == [True, True, False, False]
    one = spark.range(1)
    assert one.select(memory.cooldown_days(F.lit(6), F.lit(1)), memory.cooldown_days(F.lit(6), F.lit(3)), memory.cooldown_days(F.lit(6), F.lit(9)), memory.decayed_threshold(F.lit(0.6), F.lit(7)), memory.decayed_threshold(F.lit(0.6), F.lit(99))).first()[:] == (6, 12, 14, pytest.approx(0.425), 0.25)
    assert one.select(memory.shown_often(F.array(F.lit("2024-01-09").cast("date"), F.lit("2024-01-05").cast("date")), today)).first()[0]
    staged = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "day int, sha string")
    out = memory.settle(staged, spark.createDataFrame([(1, "a"), (2, "x")], "day int, sha string")).collect()
    assert {r.day: r.status for r in out} == {1: "delivered", 2: "mismatch", 3: "no-delivery"}
    events = spark.createDataFrame([("e", [{"at": 1, "x": "a"}, {"at": 5, "x": "b"}, {"at": None, "x": "c"}]), ("f", [{"at": 9, "x": "d"}])], "id string, samples array<struct<at:int,x:string>>")
    out = memory.filter_samples(events, "samples", F.lit(1), F.lit(4)).collect()
    assert [(r.id, [s.x for s in r.samples]) for r in out] == [("e", ["a", "c"])]


def test_rules(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "q"], "see 12 and 345", "12"), (2, "z", ["x"], "7", "")], "id int, fk string, tags array<string>, t string, src string")
    pool = spark.createDataFrame([("a",)], "k string")
    issues = rules.all_of(rules.foreign_key(rows, "fk", pool, "k", "id"), rules.vocabulary(rows, "tags", ["x"], "id"), rules.unsupported_numbers(rows, "t", "src", "id"), rules.alike(rows.withColumn("t", F.lit("same title")), title_bigrams(F.col("t")), "id"))
    assert {(r.rule, r.key, r.detail) for r in issues.collect()} == {("foreign key", "2", "z"), ("vocabulary", "1", "q"), ("numbers", "1", "345"), ("alike", "1", "2")}
    assert rules.drop_blocked(rows, "id", issues).count() == 0


def test_scores(spark):
    one = spark.range(1)
    parts = [F.lit(x) for x in (1.0, 1.0, 1.0, 1.0, 0.9)]
    assert one.select(scoring.relevance(*parts, F.lit(False), F.lit(False)), scoring.relevance(*parts, F.lit(True), F.lit(False)), scoring.relevance(*parts, F.lit(True), F.lit(True))).first()[:] == (90, 65, 84)
    assert [one.select(scoring.tier(F.lit(s), F.lit(a))).first()[0] for s, a in ((68, 0.6), (68, 0.5), (45, 0), (25, 0), (24, 1))] == ["high", "medium", "medium", "low", "drop"]


def test_normalise(spark):
    rows = spark.createDataFrame([("s", "t" * 100, " ", "2024-01-01", None), ("s", "t", "e", None, None), ("u", "t", "e", "2024-01-01", "T1")], "source_id string, title string, excerpt string, published_at string, tier string")
    out = normalize.normalize(rows, spark.createDataFrame([("s", "Source", "T2")], "id string, name string, tier string")).collect()
    assert {(r.source_id, len(r.excerpt), r.tier, r.source) for r in out} == {("s", 90, "T2", "Source"), ("u", 1, "T1", "u")}
    urls = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), ("", 4)], "url string, pos int")
    assert normalize.first_by(urls, ["url"], ["pos"]).count() == 2 and normalize.first_by(urls, ["url"], ["pos"], keep_empty=True).count() == 3
    gates = normalize.counted(urls, {"link": F.col("url") != "", "early": F.col("pos") < 2}).groupBy("dropped_by").count().collect()
    assert {r.dropped_by: r["count"] for r in gates} == {"link": 2, "early": 1, None: 1}
    crawled = normalize.from_crawl(spark.createDataFrame([("http://a/20240105/x", None), ("http://a/20240105/x", "2024-01-02 00:00:00")], "url string, published_at string"))
    assert [str(r.published_at) for r in crawled.collect()] == ["2024-01-04 16:00:00", "2024-01-01 16:00:00"]


def test_usage(spark):
    calls = spark.createDataFrame([("a", True, 10, None), ("a", False, 21, "HTTP 429"), (None, False, 5, "timed out")], "backend string, ok boolean, ms int, error string")
    out = {r.backend: (r.calls, r.failures, r.avg_ms, r.errors) for r in usage.by_group(calls.withColumn("kind", usage.classify_error(F.col("error"))), ["backend"], F.col("ok"), "ms", "kind").collect()}
    assert out == {"a": (2, 1, 16, {"quota": 1}), "unknown": (1, 1, 5, {"timeout": 1})}
    made = usage.source_yield(calls, calls.where("ok"), "backend", "ms", spark.createDataFrame([("z",)], "backend string")).where("backend = 'z'").first()
    assert (made.inflow, made.kept, made.ratio) == (0, 0, 0.0)


def test_greedy_leaders_with_groups_match_a_scan(spark):
    import random

    from feedmill.operators.dedupe import greedy_leaders

    rng = random.Random(11)
    for _ in range(4):
        n = 40
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(25)}
        keys = {(p, rng.choice("abcd")) for p in range(n) if rng.random() < 0.5} | {(p, "hot") for p in range(0, n, 3)}
        leader = {}
        for p in range(n):
            near = [q for q in range(p) if leader[q] == q and ((q, p) in pairs or any((q, k) in keys for k in {k for x, k in keys if x == p}))]
            leader[p] = min(near) if near else p
        rows = spark.createDataFrame([(p,) for p in range(n)], "pos long")
        got = greedy_leaders(rows, spark.createDataFrame(sorted(pairs), "u long, v long"), spark.createDataFrame(sorted(keys), "pos long, key string")).collect()
        assert {r.pos: r.leader for r in got} == leader
