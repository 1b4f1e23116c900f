"""Stories told by several sources, news on single shares, repeated aspects, and what an issue was lately told, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions import market, text
from feedmill.operators import dedupe, memory, ranking, rules, topics
from feedmill.plans.registry import query

#: Words of parts that stand in for companies, markets and shares.
NEWS = market.StockNews(never=("hot",), companies=("bolt", "Brand#7"), code=r"\(\d{2}\)", markets=("PROMO", "ring"), shares=("gear", "ECONOMY", "red"))


@query(r"""
WITH RECURSIVE p AS (SELECT p_partkey AS pos, lower(p_name || ' ' || p_type || ' ' || (p_size % 4) || CASE WHEN p_size % 5 = 0 THEN ' new ' || p_name ELSE '' END) AS norm, 's' || (p_partkey % 7) AS source FROM part),
f AS (SELECT norm, min(pos) AS id, list_distinct(string_split(any_value(norm), ' ')) AS g FROM p GROUP BY norm), s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS i, * FROM f),
m AS MATERIALIZED (SELECT b.i, list(a.i ORDER BY a.i) AS earlier FROM s a JOIN s b ON a.i < b.i AND len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.75 GROUP BY b.i),
k AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS home UNION ALL
  SELECT k.i + 1, CASE WHEN len(list_intersect(coalesce(m.earlier, []), k.kept)) > 0 THEN k.kept ELSE list_append(k.kept, k.i + 1) END, CASE WHEN len(list_intersect(coalesce(m.earlier, []), k.kept)) > 0 THEN list_min(list_intersect(m.earlier, k.kept)) ELSE k.i + 1 END FROM k LEFT JOIN m ON m.i = k.i + 1 WHERE k.i < (SELECT max(i) FROM s)),
h AS (SELECT s.norm, l.id AS leader FROM k JOIN s ON k.i = s.i JOIN s l ON k.home = l.i), t AS (SELECT p.pos, p.source, h.leader FROM p JOIN h ON p.norm = h.norm), o AS (SELECT pos AS leader, source AS own FROM t WHERE pos = leader),
a AS (SELECT t.leader, t.source, min(pos) AS first_at FROM t JOIN o ON t.leader = o.leader WHERE t.source <> own GROUP BY ALL), l AS (SELECT leader, string_agg(source, ',' ORDER BY first_at) AS also_from FROM a GROUP BY leader)
SELECT o.leader AS pos, own AS source, coalesce(also_from, '') AS also_from FROM o LEFT JOIN l ON o.leader = l.leader""")
def merged_stories(t):
    title = F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") % 4).cast("string"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("new "), "p_name")))
    rows = t.part.select(F.col("p_partkey").alias("pos"), title.alias("title"), F.concat(F.lit("s"), F.col("p_partkey") % 7).alias("source"))
    return dedupe.merged_stories(rows).select("pos", "source", F.array_join("also_from", ",").alias("also_from"))


@query(r"""
WITH p AS (SELECT p_partkey, p_brand, p_name || ' ' || p_type || ' ' || p_brand || ' (' || p_size || ')' AS t FROM part)
SELECT p_partkey FROM p WHERE p_partkey % 3 = 0 OR CASE WHEN contains(t, 'hot') THEN false WHEN contains(t, 'bolt') OR contains(t, 'Brand#7') THEN true WHEN regexp_matches(t, '\(\d{2}\)') THEN false WHEN contains(t, 'PROMO') OR contains(t, 'ring') THEN true ELSE NOT regexp_matches(t, 'gear|ECONOMY|red') END""")
def stock_news(t):
    title = F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit(" ("), "p_size", F.lit(")"))
    rows = t.part.select("p_partkey", title.alias("title"), F.when(F.col("p_partkey") % 3 > 0, "stocks").when(F.col("p_partkey") % 2 == 0, "gz").alias("category"))
    return market.filter_stock_news(rows, "title", "category", v=NEWS).select("p_partkey")


_G = r"list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr({0}, i, 2)))".format(r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))")


@query(f"""
WITH p AS (SELECT p_partkey AS k, [p_name || ' ' || p_size, p_type || ' ' || p_brand] AS a FROM part), j AS (SELECT x.k, unnest(x.a) AS a, y.a AS bs FROM p x JOIN p y ON x.k = y.k + 1), u AS (SELECT k, a, unnest(bs) AS b FROM j),
s AS (SELECT *, len(list_intersect({_G.format('a')}, {_G.format('b')})) / len(list_distinct(list_concat({_G.format('a')}, {_G.format('b')}))) AS score FROM u)
SELECT k AS p_partkey, round(max(score), 6) AS score, max(score) >= 0.35 AS repeats FROM s GROUP BY k""")
def hero_repeats(t):
    line = F.concat(F.lit("Today three things: "), "p_name", F.lit(" "), "p_size", F.lit("; "), "p_type", F.lit(" "), "p_brand", F.lit(";"))
    rows = t.part.select("p_partkey", text.aspects(line, "^.*?: ").alias("parts"))
    before = rows.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("parts").alias("before"))
    best = text.most_repeated(F.col("parts"), F.col("before"))["score"]
    return rows.join(before, "p_partkey").select("p_partkey", F.round(best, 6).alias("score"), (best >= 0.35).alias("repeats"))


@query("""
WITH e AS (SELECT o_custkey AS event, o_orderpriority AS channel, max(CAST(o_orderdate AS DATE)) AS last_day, list_sort(list_distinct(list(o_orderstatus))) AS used FROM orders GROUP BY ALL),
a AS (SELECT *, date_diff('day', last_day, DATE '2001-07-20') AS age FROM e)
SELECT channel, event, age, coalesce(list_filter(['F', 'P', 'O'], lambda x: NOT list_contains(used, x))[1], used[1]) AS angle FROM a WHERE age BETWEEN 0 AND 30 QUALIFY row_number() OVER (PARTITION BY channel ORDER BY age, event) <= 8""")
def memory_brief(t):
    events = t.orders.groupBy(F.col("o_custkey").alias("event"), F.col("o_orderpriority").alias("channel")).agg(F.max(F.to_date("o_orderdate")).alias("last_day"), F.array_sort(F.collect_set("o_orderstatus")).alias("used"))
    angles = F.array(F.lit("F"), F.lit("P"), F.lit("O"))
    return memory.brief(events, F.lit("2001-07-20").cast("date"), "channel", ["event"], angles, "used", 30, 8).select("channel", "event", "age", "angle")


@query(r"""
WITH p AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents)
SELECT 'purity' AS rule, CASE WHEN lang IS DISTINCT FROM 'en' THEN 'block' ELSE 'warn' END AS level, CAST(doc_id AS VARCHAR) AS key, CASE WHEN lang IS DISTINCT FROM 'en' THEN lang END AS detail FROM p WHERE source IN ('src1', 'src2') AND (lang IS DISTINCT FROM 'en' OR NOT regexp_matches(t, '(?i)that the|tion of'))
UNION ALL SELECT 'untranslated', 'warn', CAST(doc_id AS VARCHAR), CAST(len(regexp_extract_all(t, '[A-Za-z]{12,}')) AS VARCHAR) FROM p WHERE len(regexp_extract_all(t, '[A-Za-z]{12,}')) >= 9""")
def issue_checks(t):
    pure = rules.purity(t.documents, F.col("source").isin("src1", "src2"), "lang", "en", ["that the", "tion of"], F.col("text"), "doc_id")
    return pure.unionByName(rules.untranslated(t.documents, "text", "doc_id", 12, 9))


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus AS section, o_custkey % 40 AS source, o_totalprice AS value, o_orderkey % 100 AS score FROM orders), c AS (SELECT *, CASE section WHEN 'F' THEN 4 WHEN 'O' THEN 3 END AS each, CASE section WHEN 'F' THEN 60 WHEN 'O' THEN 110 END AS whole FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY section, source ORDER BY value DESC, o_orderkey) AS nth FROM c WHERE each IS NOT NULL), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY o_orderkey) AS place FROM b WHERE nth <= each) WHERE place <= whole),
n AS (SELECT section, count(*) AS n FROM s GROUP BY section), l AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, value DESC, o_orderkey) AS late FROM b WHERE nth > each AND score >= 90)
SELECT o_orderkey FROM c WHERE each IS NULL UNION ALL SELECT o_orderkey FROM s UNION ALL SELECT o_orderkey FROM l JOIN n USING (section) WHERE late <= whole + 5 - n""")
def display_caps(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("section"), (F.col("o_custkey") % 40).alias("source"), F.col("o_totalprice").alias("value"), (F.col("o_orderkey") % 100).alias("score"))
    return ranking.display_caps(rows, "section", "source", [F.desc("value"), "o_orderkey"], "score", ["o_orderkey"], {"F": (4, 60), "O": (3, 110)}, 90, 5).select("o_orderkey")


_PAIRS = r"list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
_LETTERS = r"regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"""
WITH p AS (SELECT p_partkey AS k, [p_name, p_type, p_brand, '#'] AS topics, p_name || '; ' || p_type || ' and ' || p_brand || ';' AS line, CASE p_size % 3 WHEN 0 THEN 'hot day' WHEN 1 THEN 'cold day' END AS day FROM part), j AS (SELECT x.k, x.topics, y.line FROM p x JOIN p y ON x.k = y.k + 1),
u AS (SELECT k, unnest(topics) AS topic, list_transform(list_filter(string_split(line, ';'), lambda c: {_LETTERS.format('c')} <> ''), lambda c: {_LETTERS.format('c')}) AS clauses FROM j),
l AS (SELECT k, topic FROM u WHERE {_LETTERS.format('topic')} <> '' AND len(list_filter(clauses, lambda c: len(list_filter({_PAIRS.format(_LETTERS.format('topic'))}, lambda g: list_contains({_PAIRS.format('c')}, g))) >= 3)) = 0)
SELECT 'uncovered' AS rule, CAST(k AS VARCHAR) AS key, string_agg(topic, ',' ORDER BY topic) AS detail FROM l GROUP BY k UNION ALL SELECT 'time wording', CAST(k AS VARCHAR), day FROM p WHERE day = 'cold day' AND contains(line, 'hot')""")
def hero_audits(t):
    line = F.concat("p_name", F.lit("; "), "p_type", F.lit(" and "), "p_brand", F.lit(";"))
    rows = t.part.select("p_partkey", F.array("p_name", "p_type", "p_brand", F.lit("#")).alias("topics"), line.alias("line"), F.when(F.col("p_size") % 3 == 0, "hot day").when(F.col("p_size") % 3 == 1, "cold day").alias("day"))
    before = rows.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("line").alias("spoken"))
    left = rows.join(before, "p_partkey").select(F.col("p_partkey").cast("string").alias("key"), F.array_sort(text.uncovered(F.col("topics"), F.col("spoken"))).alias("left")).where(F.size("left") > 0)
    found = left.select(F.lit("uncovered").alias("rule"), "key", F.array_join("left", ",").alias("detail"))
    return found.unionByName(rules.time_wording(rows, "line", "day", "p_partkey", "hot", ("hot",)).select("rule", "key", "detail"))


@query(r"""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN coalesce(source, '') ELSE lang END AS title, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 3 END AS importance, lang AS tags,
  CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) > 90 THEN left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 90) || '…' ELSE trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) END AS summary FROM documents WHERE doc_id % 7 > 0""")
def slim_items(t):
    d = t.documents
    items = d.select(
        F.when(F.col("doc_id") % 7 > 0, F.col("doc_id").cast("string")).otherwise("").alias("id"), F.lit("2024-01-01").cast("date").alias("date"), F.col("source").alias("section"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("title_cn"), F.col("source").alias("title_orig"), "source",
        F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3).alias("importance"), F.array(F.lit(""), "lang", F.lit(None).cast("string")).alias("tags"), F.col("text").alias("summary"),
    )
    return topics.slim(items).select("id", "title", "importance", F.array_join("tags", ",").alias("tags"), "summary")
