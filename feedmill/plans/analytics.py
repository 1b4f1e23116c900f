"""Similarity, scoring, rules, topics, memory and indicators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedmill.functions import lexicon, text
from feedmill.operators import dedupe, indicators, memory, rules, scoring, topics
from feedmill.plans.registry import query

_GRAMS = """list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr({0}, i, 2)))"""
_NORM = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def _grams(column):
    return _GRAMS.format(_NORM.format(column))


@query(f"""
SELECT item_id, CAST(len({_grams('text')}) AS INTEGER) AS n, array_to_string(list_sort({_grams('text')}), ' ') AS grams FROM benchmark""")
def title_bigrams(t):
    g = text.title_bigrams(F.col("text"))
    return t.benchmark.select("item_id", F.size(g).alias("n"), F.array_join(F.array_sort(g), " ").alias("grams"))


_PAIR = """
WITH g AS (SELECT conv_id, turn, {grams} AS a, lag({grams}) OVER (PARTITION BY conv_id ORDER BY turn) AS b,
  list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS u, lag(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard, round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS dice,
  round(len(list_intersect(u, v)) / (len(u) + len(v) - len(list_intersect(u, v))), 6) AS tokens, round(len(list_intersect(u, v)) / len(u), 6) AS coverage FROM g WHERE b IS NOT NULL"""


@query(_PAIR.format(grams=_grams("text")))
def turn_similarity(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    sets = t.conversations.select("conv_id", "turn", text.title_bigrams(F.col("text")).alias("a"), text.tokens(F.col("text")).alias("u"))
    both = sets.withColumn("b", F.lag("a").over(w)).withColumn("v", F.lag("u").over(w)).where("b is not null")
    a, b, u, v = map(F.col, "abuv")
    return both.select("conv_id", "turn", F.round(text.jaccard(a, b), 6).alias("jaccard"), F.round(text.dice(a, b), 6).alias("dice"), F.round(text.jaccard(u, v, empty=0.0), 6).alias("tokens"), F.round(text.coverage(u, v), 6).alias("coverage"))


@query(f"""
WITH g AS (SELECT item_id AS id, {_grams('text')} AS g FROM benchmark), s AS (SELECT a.id, b.id AS other, len(list_intersect(a.g, b.g)) AS n, len(a.g) + len(b.g) AS total FROM g a, g b WHERE a.id <> b.id)
SELECT id, other, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT id, other, 2 * n / total AS score, row_number() OVER (PARTITION BY id ORDER BY 2 * n / total DESC, other) AS rank FROM s WHERE n >= 2 AND 2 * n / total >= 0.16) WHERE rank <= 3""")
def title_dice_top3(t):
    rows = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    out = dedupe.nearest_titles(rows, rows, top=4).where("id <> other")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return out.withColumn("rank", rank).where("rank <= 3").select("id", "other", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH g AS (SELECT page_id, {_grams('url')} AS g FROM pages) SELECT a.page_id AS u, b.page_id AS v, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS score
FROM g a JOIN g b ON a.page_id < b.page_id WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.7""")
def near_dup_pairs(t):
    sets = t.pages.select(F.col("page_id").alias("id"), text.title_bigrams(F.col("url")).alias("grams"))
    return dedupe.similar_pairs(sets, None, 0.7).select("u", "v", F.round("score", 6).alias("score"))


@query(f"""
WITH RECURSIVE g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY page_id) AS i, page_id AS pos, url AS title, {_grams('url')} AS g FROM pages),
m AS MATERIALIZED (SELECT b.i, list(a.i) AS earlier FROM g a JOIN g b ON a.i < b.i WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.7 GROUP BY b.i),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders UNION ALL SELECT s.i + 1, CASE WHEN len(list_intersect(coalesce(m.earlier, []), s.leaders)) > 0 THEN s.leaders ELSE list_append(s.leaders, s.i + 1) END FROM s LEFT JOIN m ON m.i = s.i + 1 WHERE s.i < (SELECT max(i) FROM g)),
l AS (SELECT leaders FROM s WHERE i = (SELECT max(i) FROM g)), f AS (SELECT g.i, g.pos, g.title, coalesce(list_min(list_intersect(coalesce(m.earlier, []), l.leaders)), g.i) AS leader FROM g LEFT JOIN m ON m.i = g.i, l)
SELECT f.pos, f.title, h.pos AS leader FROM f JOIN g h ON h.i = f.leader""")
def dedupe_greedy(t):
    return dedupe.title_clusters(t.pages.select(F.col("page_id").alias("pos"), F.col("url").alias("title")), 0.7)


@query(f"""
WITH g AS (SELECT page_id, url, {_grams('url')} AS g FROM pages), h AS (SELECT g FROM g WHERE url LIKE 'https://m.%')
SELECT page_id AS pos, url AS title FROM g WHERE url NOT LIKE 'https://m.%' AND NOT EXISTS (SELECT 1 FROM h WHERE 2 * len(list_intersect(g.g, h.g)) / (len(g.g) + len(h.g)) >= 0.6)""")
def dedupe_vs_history(t):
    rows = t.pages.select(F.col("page_id").alias("pos"), F.col("url").alias("title"))
    old = F.col("title").startswith("https://m.")
    return dedupe.not_in_history(rows.where(~old), rows.where(old))


_RULES = scoring.Rules(
    global_exclude=["black"],
    geo_exact=["Brand#1$", "Brand#2$"],
    geo_risky=["Brand#1"],
    dimensions={"metal": scoring.Dimension(strong=["bolt", "nut"], weak=["ring"], together=["red", "blue"], exclude=["wood"]), "size": scoring.Dimension(strong=["small"], weak=["large"])},
    trackers={"economy": scoring.Tracker("A", ["ECONOMY"]), "premium": scoring.Tracker("S", ["PROMO"], exclude_title=["green"]), "local": scoring.Tracker("B", ["STANDARD"], geo_lock=True)},
)


@query("""
WITH p AS (SELECT p_partkey, p_name, p_name || ' ' || p_type || ' ' || p_brand AS body FROM part),
h AS (SELECT *, NOT regexp_matches(p_name, '(?i)black') AS passes, CASE WHEN regexp_matches(body, '(?i)Brand#1$|Brand#2$') THEN 100 WHEN regexp_matches(body, '(?i)Brand#1') THEN 60 ELSE 0 END AS geo,
  CASE WHEN regexp_matches(body, '(?i)wood') THEN NULL WHEN regexp_matches(body, '(?i)bolt|nut') THEN 'strong' WHEN regexp_matches(body, '(?i)ring') AND regexp_matches(body, '(?i)red|blue') THEN 'weak' WHEN regexp_matches(body, '(?i)ring') THEN 'gray' END AS metal,
  CASE WHEN regexp_matches(body, '(?i)small') THEN 'strong' WHEN regexp_matches(body, '(?i)large') THEN 'gray' END AS size,
  regexp_matches(body, '(?i)ECONOMY') AS t1, regexp_matches(body, '(?i)PROMO') AND NOT regexp_matches(p_name, '(?i)green') AS t2 FROM p),
k AS (SELECT *, regexp_matches(body, '(?i)STANDARD') AND geo >= 100 AS t3 FROM h)
SELECT p_partkey, passes, geo, coalesce(metal, '') || '/' || coalesce(size, '') AS hits, CASE WHEN t2 THEN 'premium' WHEN t1 THEN 'economy' WHEN t3 THEN 'local' ELSE '' END AS tracker,
  geo + CASE coalesce(metal, '') WHEN 'strong' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END + CASE WHEN size = 'strong' THEN 2 ELSE 0 END + CASE WHEN t1 OR t2 OR t3 THEN 1000 ELSE 0 END AS score FROM k""")
def funnel_bucket(t):
    rows = t.part.withColumn("body", F.concat_ws(" ", "p_type", "p_brand"))
    out = scoring.funnel(rows, "p_name", "body", _RULES)
    hit = lambda name: F.coalesce(F.get(F.transform(F.filter("dimensions", lambda d: d["name"] == name), lambda d: d["hit"]), F.lit(0)), F.lit(""))
    return out.select("p_partkey", "passes", "geo", F.concat(hit("metal"), F.lit("/"), hit("size")).alias("hits"), F.coalesce(F.get("trackers", F.lit(0))["name"], F.lit("")).alias("tracker"), F.col("funnel_score").cast("int").alias("score"))


_LINES = [(["bolt", "nut"], 1.0), (["ring", "plate"], 0.7), (["widget"], 0.4)]


@query("""
WITH s AS (SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)bolt|nut') THEN 1.0::DOUBLE WHEN regexp_matches(p_name, '(?i)ring|plate') THEN 0.7::DOUBLE WHEN regexp_matches(p_name, '(?i)widget') THEN 0.4::DOUBLE ELSE 0::DOUBLE END AS line,
  CASE p_type WHEN 'PROMO' THEN 0.95::DOUBLE WHEN 'STANDARD' THEN 0.6::DOUBLE ELSE 0.42::DOUBLE END AS authority, CASE WHEN p_size >= 25 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS act, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 1.0::DOUBLE ELSE 0::DOUBLE END AS loc,
  CASE WHEN p_size <= 10 THEN 1.0::DOUBLE WHEN p_size <= 20 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS factor, p_type = 'SMALL' AS regional, p_brand = 'Brand#7' AND p_size > 40 AS forced FROM part),
b AS (SELECT *, floor(floor(floor(100 * (0.45::DOUBLE * line + 0.25::DOUBLE * authority + 0.2::DOUBLE * act + 0.1::DOUBLE * loc) + 0.5) * factor + 0.5) * CASE WHEN regional THEN 0.72::DOUBLE ELSE 1.0::DOUBLE END + 0.5) AS aged FROM s),
r AS (SELECT p_partkey, act, CAST(CASE WHEN forced THEN greatest(aged, 84) ELSE aged END AS BIGINT) AS score FROM b)
SELECT p_partkey, score, CASE WHEN score >= 68 AND act >= 0.6 THEN 'high' WHEN score >= 45 THEN 'medium' WHEN score >= 25 THEN 'low' ELSE 'drop' END AS tier FROM r""")
def relevance_score(t):
    line = lexicon.first_value(F.col("p_name"), _LINES)
    authority = F.when(F.col("p_type") == "PROMO", 0.95).when(F.col("p_type") == "STANDARD", 0.6).otherwise(0.42)
    action = F.when(F.col("p_size") >= 25, 0.8).otherwise(0.3)
    locality = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), 1.0).otherwise(0.0)
    factor = F.when(F.col("p_size") <= 10, 1.0).when(F.col("p_size") <= 20, 0.9).otherwise(0.8)
    score = scoring.relevance(line, authority, action, locality, factor, F.col("p_type") == "SMALL", (F.col("p_brand") == "Brand#7") & (F.col("p_size") > 40))
    return t.part.select("p_partkey", score.alias("score"), scoring.tier(score, action).alias("tier"))


@query("""
SELECT p_partkey, a AS one, b AS two, a >= 25 AND b >= 25 AS dual, labels FROM (SELECT p_partkey, least((CASE WHEN regexp_matches(p_name, '(?i)bolt|nut') THEN 60 ELSE 0 END) + (CASE WHEN regexp_matches(p_name, '(?i)red|blue') THEN 50 ELSE 0 END), 100)::DOUBLE AS a,
  (CASE WHEN regexp_matches(p_name, '(?i)red|small') THEN 30 ELSE 0 END)::DOUBLE AS b, concat_ws(',', CASE WHEN regexp_matches(p_name, '(?i)red|blue|green') THEN 'colour' END, CASE WHEN regexp_matches(p_name, '(?i)small|large') THEN 'size' END) AS labels FROM part)""")
def dual_and_labels(t):
    name = F.col("p_name")
    both = scoring.dual(name, [(["bolt", "nut"], 60), (["red", "blue"], 50)], [(["red", "small"], 30)])
    return t.part.select("p_partkey", both["one"].alias("one"), both["two"].alias("two"), both["dual"].alias("dual"), F.array_join(lexicon.all_matches(name, {"colour": ["red", "blue", "green"], "size": ["small", "large"]}), ",").alias("labels"))


@query(r"""
SELECT 'foreign key' AS rule, 'block' AS level, CAST(l_orderkey AS VARCHAR) AS key, CAST(l_partkey AS VARCHAR) AS detail FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)
UNION ALL SELECT 'vocabulary', 'warn', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
UNION ALL SELECT 'length', 'warn', CAST(item_id AS VARCHAR), CAST(length(text) AS VARCHAR) FROM benchmark WHERE length(text) NOT BETWEEN 100 AND 300
UNION ALL SELECT 'quota', 'warn', o_orderstatus, CAST(count(*) AS VARCHAR) FROM orders WHERE o_totalprice > 400000 GROUP BY o_orderstatus HAVING count(*) > 3
UNION ALL SELECT 'unique', 'block', CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR), CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'stale', 'warn', CAST(user_id AS VARCHAR), CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') AS VARCHAR) FROM events GROUP BY user_id HAVING date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') > 2
UNION ALL SELECT 'wording', 'warn', CAST(doc_id AS VARCHAR), 'text' FROM documents WHERE regexp_matches(text, '(?i)idiot|licensed under')
UNION ALL SELECT 'evidence', 'block', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR) FROM events WHERE NOT contains(props, CAST(user_id AS VARCHAR))""")
def violations(t):
    ev = t.events.withColumn("quote", F.col("user_id").cast("string"))
    return rules.all_of(
        rules.foreign_key(t.lineitem, "l_partkey", t.part.where("p_size > 1"), "p_partkey", "l_orderkey"),
        rules.vocabulary(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "o_orderkey"),
        rules.length_between(t.benchmark, "text", 100, 300, "item_id"),
        rules.at_most(t.orders, ["o_orderstatus"], F.col("o_totalprice") > 400000, 3),
        rules.unique(t.lineitem, ["l_orderkey", "l_linenumber"]),
        rules.stale(t.events.withColumn("day", F.to_date("ts")), ["user_id"], "day", F.to_date(F.lit("2024-01-31")), 2),
        rules.pattern(t.documents, "text", ["idiot", "licensed under"], "doc_id"),
        rules.evidence(ev, "quote", "props", "event_id"),
    )


def _items(t):
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.array("event_type", F.concat(F.lit("k"), F.floor(k / 10).cast("string")))
    importance = F.when(F.col("value") > 50, 3).when(F.col("value") > 10, 2).otherwise(1)
    return t.events.select(F.col("event_id").alias("id"), F.to_date("ts").alias("date"), F.col("event_type").alias("section"), tags.alias("tags"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("summary"), importance.alias("importance"))


_NODES = """
WITH items AS (SELECT event_id AS id, CAST(ts AS DATE) AS date, event_type AS section, [event_type, 'k' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS VARCHAR)] AS tags, CASE WHEN value > 50 THEN 3 WHEN value > 10 THEN 2 ELSE 1 END AS importance FROM events),
tagged AS (SELECT id, date, section, importance, unnest(tags) AS tag FROM items),
freq AS (SELECT tag, sum(n) AS n, max(n) AS top, (SELECT count(*) FROM items) AS total FROM (SELECT tag, section, count(*) AS n FROM tagged GROUP BY tag, section) GROUP BY tag),
fit AS (SELECT tag, n FROM freq WHERE NOT (n >= 3 AND n / total >= 0.35 AND top / n < 0.8) AND tag <> 'error'),
main AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY f.n, t.tag) AS r FROM tagged t JOIN fit f ON t.tag = f.tag) WHERE r = 1)"""


@query(_NODES + """,
g AS (SELECT tag, upper(tag) AS label, count(*) AS n_items, max(importance) AS top, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM main GROUP BY tag HAVING count(*) >= 2 AND count(DISTINCT date) >= 2),
s AS (SELECT *, date_diff('day', first_date, last_date) + 1 AS span_days, greatest(date_diff('day', last_date, DATE '2024-02-05'), 0) AS age FROM g)
SELECT tag, label, n_items, n_dates, first_date, last_date, CAST(span_days AS INTEGER) AS span_days, CAST(floor(100 * (0.4::DOUBLE * (0.7::DOUBLE * least(1.0::DOUBLE, n_dates / 12) + 0.3::DOUBLE * least(1.0::DOUBLE, n_dates / greatest(1.0::DOUBLE, span_days * 0.5::DOUBLE)))
  + 0.25::DOUBLE * greatest(0.0::DOUBLE, 1 - age / 90) + 0.25::DOUBLE * (0.6::DOUBLE * least(1.0::DOUBLE, top / 3) + 0.4::DOUBLE * least(1.0::DOUBLE, n_items / 12)) + 0.1::DOUBLE) + 0.5) AS BIGINT) AS quality, age <= 7 AS active, age >= 90 AS dormant
FROM s ORDER BY n_items DESC, label LIMIT 30""")
def topic_cluster(t):
    nodes = topics.dedupe_items(_items(t))
    labels = nodes.select(F.explode("tags").alias("tag")).distinct().where("tag <> 'error'").withColumn("label", F.upper("tag"))
    return topics.topics(nodes, labels, F.to_date(F.lit("2024-02-05")))


@query(_NODES + """ SELECT tag, count(*) AS n FROM tagged GROUP BY tag""")
def tag_frequency(t):
    return topics.tag_frequency(topics.dedupe_items(_items(t))).select("tag", "n")


@query("""
WITH i AS (SELECT user_id AS id, CAST(ts AS DATE) AS date FROM events), e AS (SELECT id, count(DISTINCT date) AS n FROM i GROUP BY id)
SELECT (SELECT count(DISTINCT date) FROM i) AS days, (SELECT min(date) FROM i) AS first_day, (SELECT max(date) FROM i) AS last_day, (SELECT count(*) FROM e) AS items, (SELECT CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM e) AS repeated""")
def corpus_stats(t):
    return topics.corpus_stats(t.events.select(F.col("user_id").alias("id"), F.to_date("ts").alias("date")))


@query("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS url, event_type AS title, ts, CASE WHEN event_type = 'purchase' THEN props END AS summary, CASE WHEN event_type <> 'error' THEN value > 20 END AS relevant, ts + INTERVAL 1 SECOND AS seen_at FROM events)
SELECT url, arg_max(title, seen_at) AS title, CAST(arg_max(ts, seen_at) AS DATE) AS published, arg_max(summary, seen_at) FILTER (WHERE summary IS NOT NULL) AS summary, arg_max(relevant, seen_at) FILTER (WHERE relevant IS NOT NULL) AS relevant, CAST(min(seen_at) AS DATE) AS first_seen, CAST(max(seen_at) AS DATE) AS last_seen FROM e GROUP BY url""")
def history_upsert(t):
    rows = t.events.select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("title"), F.col("ts").alias("published_at"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("summary"), F.when(F.col("event_type") != "error", F.col("value") > 20).alias("relevant"), F.expr("ts + interval 1 second").alias("seen_at"))
    cut = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    out = memory.upsert_history(rows.where(F.col("seen_at") < cut), rows.where(F.col("seen_at") >= cut))
    return out.select("url", "title", F.to_date("published_at").alias("published"), "summary", "relevant", F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"))


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d)
SELECT user_id, min(day) AS streak_start, count(*) AS days FROM r GROUP BY user_id, run""")
def streaks(t):
    return memory.streaks(t.events.where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("""
WITH d AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2, 3),
l AS (SELECT *, date_diff('day', lag(day) OVER w, day) AS age, row_number() OVER w AS k, lag(top) OVER w AS before FROM d WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day)),
v AS (SELECT *, k > 1 AS matched, coalesce(age, 0) AS a, least(floor(3 * (1 + 0.5::DOUBLE * (greatest(k - 1, 1) - 1)) + 0.5), 14) AS cool, CASE WHEN k > 1 AND top > before THEN least((top - before) / top, 1) ELSE 0 END AS novel FROM l)
SELECT user_id, event_type, day, CAST(cool AS BIGINT) AS cooldown, CASE WHEN NOT matched THEN 'new' WHEN k - 1 >= 6 THEN 'exhausted' WHEN novel >= greatest(0.25::DOUBLE, 0.6::DOUBLE - (0.6::DOUBLE - 0.25::DOUBLE) * least(1.0::DOUBLE, a / 14)) THEN CASE WHEN a >= cool THEN 'refresh' ELSE 'progress' END WHEN a < cool THEN 'cooldown' ELSE 'duplicate' END AS verdict FROM v""")
def cooldown_verdict(t):
    daily = t.events.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("top"))
    w = Window.partitionBy("user_id", "event_type").orderBy("day")
    rows = daily.withColumn("age", F.coalesce(F.datediff("day", F.lag("day").over(w)), F.lit(0))).withColumn("k", F.row_number().over(w)).withColumn("before", F.lag("top").over(w))
    cool = memory.cooldown_days(F.lit(3), F.greatest(F.col("k") - 1, F.lit(1)))
    novel = F.when((F.col("k") > 1) & (F.col("top") > F.col("before")), F.least((F.col("top") - F.col("before")) / F.col("top"), F.lit(1.0))).otherwise(0.0)
    said = memory.verdict(F.col("k") > 1, F.col("age"), cool, novel, memory.decayed_threshold(F.lit(0.6), F.col("age")), F.col("k") - 1)
    return rows.select("user_id", "event_type", "day", cool.cast("long").alias("cooldown"), said.alias("verdict"))


@query(r"""
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS u FROM conversations), p AS (SELECT *, lag(u) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM w)
SELECT conv_id, turn, round(least(1.0, 0.8::DOUBLE * CASE WHEN len(u) = 0 THEN 0 ELSE len(list_filter(u, lambda x: NOT list_contains(v, x))) / len(u) END), 6) AS novelty FROM p WHERE v IS NOT NULL""")
def novelty(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumn("u", text.tokens(F.col("text"))).withColumn("v", F.lag("u").over(w)).where("v is not null")
    return rows.select("conv_id", "turn", F.round(memory.novelty(F.col("u"), F.col("v"), F.col("u"), F.col("v"), F.lit(False), F.lit(False)), 6).alias("novelty"))


_SERIES = """
p AS (SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, round(avg(l_extendedprice / l_quantity), 6) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _series(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("symbol"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("d")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("close"))


@query(f"""
WITH {_SERIES} SELECT symbol, d, round(m, 4) AS sma FROM (SELECT symbol, d, avg(close) OVER w AS m, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING)) WHERE n = 20""")
def sma(t):
    return indicators.sma(_series(t), "close", 20).select("symbol", "d", F.round("sma", 4).alias("sma"))


_EMA = "list_reduce(list_prepend(list_avg({0}[1:{1}]), {0}[{1} + 1:]), lambda a, x: a + (x - a) * 2.0::DOUBLE / ({1} + 1))"


@query(f"""
WITH {_SERIES}, l AS (SELECT symbol, list(close ORDER BY d) AS c FROM p GROUP BY symbol) SELECT symbol, round({_EMA.format('c', 12)}, 4) AS ema12, round({_EMA.format('c', 26)}, 4) AS ema26, len(c) AS n FROM l WHERE len(c) >= 26""")
def ema(t):
    lists = _series(t).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "close"))), lambda x: x["close"]).alias("c")).where(F.size("c") >= 26)  # months of a symbol
    last = lambda n: F.round(indicators.last_ema(F.col("c"), n), 4)
    return lists.select("symbol", last(12).alias("ema12"), last(26).alias("ema26"), F.size("c").cast("long").alias("n"))


_WILDER = "list_reduce(list_prepend(list_avg({0}[1:14]), {0}[15:]), lambda a, x: (a * 13 + x) / 14)"


@query(f"""
WITH {_SERIES}, c AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY d) AS diff FROM p),
l AS (SELECT symbol, max(d) AS d, list(greatest(diff, 0::DOUBLE) ORDER BY d) FILTER (WHERE diff IS NOT NULL) AS g, list(greatest(-diff, 0::DOUBLE) ORDER BY d) FILTER (WHERE diff IS NOT NULL) AS s FROM c GROUP BY symbol)
SELECT symbol, d, round(100 - 100 / (1 + {_WILDER.format('g')} / CASE WHEN {_WILDER.format('s')} = 0 THEN 1e-10 ELSE {_WILDER.format('s')} END), 4) AS rsi FROM l WHERE len(g) >= 14""")
def rsi(t):
    out = indicators.rsi(_series(t))
    return out.groupBy("symbol").agg(F.max("d").alias("d"), F.round(F.max_by("rsi", "d"), 4).alias("rsi"))


@query(f"""
WITH RECURSIVE {_SERIES}, q AS MATERIALIZED (SELECT symbol, d, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS n FROM p),
s AS (SELECT symbol, d, n, close / 12 AS a, close / 26 AS b, 0::DOUBLE AS c FROM q WHERE n = 1
  UNION ALL SELECT q.symbol, q.d, q.n, CASE WHEN q.n <= 12 THEN s.a + q.close / 12 ELSE s.a + (q.close - s.a) * 2.0::DOUBLE / 13 END, CASE WHEN q.n <= 26 THEN s.b + q.close / 26 ELSE s.b + (q.close - s.b) * 2.0::DOUBLE / 27 END,
    CASE WHEN q.n < 26 THEN 0 WHEN q.n <= 34 THEN s.c + ((CASE WHEN q.n <= 12 THEN s.a + q.close / 12 ELSE s.a + (q.close - s.a) * 2.0::DOUBLE / 13 END) - (CASE WHEN q.n <= 26 THEN s.b + q.close / 26 ELSE s.b + (q.close - s.b) * 2.0::DOUBLE / 27 END)) / 9
    ELSE s.c + (((s.a + (q.close - s.a) * 2.0::DOUBLE / 13) - (s.b + (q.close - s.b) * 2.0::DOUBLE / 27)) - s.c) * 2.0::DOUBLE / 10 END FROM s JOIN q ON q.symbol = s.symbol AND q.n = s.n + 1)
SELECT symbol, d, round(a - b, 4) AS macd, round(c, 4) AS signal, round(a - b - c, 4) AS histogram FROM s WHERE n >= 34""")
def macd(t):
    out = indicators.macd(_series(t))
    return out.select("symbol", "d", *(F.round(c, 4).alias(c) for c in ("macd", "signal", "histogram")))


@query(f"""
WITH {_SERIES}, m AS (SELECT symbol, d, avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS 4 PRECEDING) AS fast, avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING) AS slow FROM p),
g AS (SELECT symbol, d, round(fast - slow, 6) AS gap, round(lag(fast - slow) OVER (PARTITION BY symbol ORDER BY d), 6) AS before FROM m)
SELECT symbol, d, CASE WHEN before <= 0 AND gap > 0 THEN 'up' ELSE 'down' END AS direction FROM g WHERE (before <= 0 AND gap > 0) OR (before >= 0 AND gap < 0)""")
def cross(t):
    w = Window.partitionBy("symbol").orderBy("d")
    rows = _series(t).withColumn("gap", F.round(F.avg("close").over(w.rowsBetween(-4, 0)) - F.avg("close").over(w.rowsBetween(-19, 0)), 6)).withColumn("zero", F.lit(0.0))
    return indicators.crosses(rows, "gap", "zero").select("symbol", "d", "direction")


@query(f"""
WITH {_SERIES}, f AS (SELECT *, (close / lag(close, 1) OVER w - 1) * 100 AS p1, (close / lag(close, 5) OVER w - 1) * 100 AS p5, max(close) OVER (PARTITION BY symbol ORDER BY d ROWS 251 PRECEDING) AS hi, min(close) OVER (PARTITION BY symbol ORDER BY d ROWS 251 PRECEDING) AS lo,
  avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING) AS m20, avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS 49 PRECEDING) AS m50, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS last FROM p WINDOW w AS (PARTITION BY symbol ORDER BY d))
SELECT symbol, d, round(p1, 4) AS pct_1d, round(p5, 4) AS pct_5d, hi AS high_52w, lo AS low_52w, CASE WHEN close > m20 AND m20 > m50 THEN 'up' WHEN close < m20 AND m20 < m50 THEN 'down' ELSE 'flat' END AS trend,
  CASE WHEN close >= hi * 0.97 THEN 'near high' WHEN close <= lo * 1.03 THEN 'near low' ELSE 'between' END AS place_52w FROM f WHERE last = 1""")
def ticker(t):
    out = indicators.ticker(_series(t))
    return out.select("symbol", "d", F.round("pct_1d", 4).alias("pct_1d"), F.round("pct_5d", 4).alias("pct_5d"), "high_52w", "low_52w", "trend", "place_52w")
