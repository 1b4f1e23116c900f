"""Lines of business, authority, action, nearness, markets and leading items; the rules read words that the tables have, and the SQL computes them on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions import desk
from feedmill.operators import executive
from feedmill.plans.registry import query

#: Rules of a desk in words that the documents have.
WORDS = desk.Desk(
    departments={"one": ("tion of", "that the"), "two": ("und der",), "three": ("que la", "of the")}, tags={"fr": "two", "de": "four"}, lines={"l1": ("the re", "del"), "l2": ("ing in",), "l3": ("la",)},
    themes={"t1": ("The", "ing", "und "), "t2": ("des", "the", "QUE")}, issuers=((("that the",), 0.95), (("ing in", "des"), 0.8), (("of",), 0.6)), foreign=("en la", "is the"), sources={"src1": 0.9, "src2": 0.5}, floors={"en": 0.3, "de": 0.7},
    actions=(("act", 0.9, ("that the", "que la")), ("risk", 0.85, ("und der", "re of")), ("soft", 0.2, ("the",))), other_action=("none", 0.5), nearest=("tion of", "des"), near=("ing in",),
)
_HIT = lambda words: f"regexp_matches(t, '(?i){words}')"
_NAMES = lambda rules: "list_filter([" + ", ".join(f"CASE WHEN {_HIT(words)} THEN '{name}' END" for name, words in rules) + "], lambda x: x IS NOT NULL)"
_IN = lambda words: "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(lower(t), lower(w)))"


@query(f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents), f AS (SELECT *, {_NAMES((("one", "tion of|that the"), ("two", "und der"), ("three", "que la|of the")))} AS own, CASE lang WHEN 'fr' THEN ['fr', 'two'] WHEN 'de' THEN ['de', 'four'] WHEN 'en' THEN [] ELSE [lang] END AS free FROM d)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(own, free))), ',') AS tags, array_to_string({_NAMES((("l1", "the re|del"), ("l2", "ing in"), ("l3", "la")))}, ',') AS lines,
  array_to_string({_IN(("The", "ing", "und "))}, ',') AS credit, array_to_string(list_sort({_IN(("The", "ing", "und ", "des", "the", "QUE"))}), ',') AS themes, '' AS other FROM f""")
def desk_tags(t):
    title, lang = F.col("text"), F.col("lang")
    key = lambda line: desk.theme_keys(title, line, WORDS)
    tags = F.array_sort(desk.rolled_up(title, F.when(lang != "en", F.array(lang)), WORDS))
    joined = {"tags": tags, "lines": desk.lines_reached(title, WORDS), "credit": key(F.lit("t1")), "themes": F.array_sort(key(F.lit(None).cast("string"))), "other": key(F.lit("else"))}
    return t.documents.select("doc_id", *(F.array_join(c, ",").alias(n) for n, c in joined.items()))


@query(f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CASE WHEN {_HIT("en la|is the")} THEN 0.0 WHEN {_HIT("that the")} THEN 0.95 WHEN {_HIT("ing in|des")} THEN 0.8 WHEN {_HIT("of")} THEN 0.6 ELSE 0.0 END::DOUBLE AS issuer,
  greatest(CASE source WHEN 'src1' THEN 0.9 WHEN 'src2' THEN 0.5 ELSE 0.42 END, CASE lang WHEN 'en' THEN 0.3 WHEN 'de' THEN 0.7 ELSE 0.0 END)::DOUBLE AS authority,
  CASE WHEN {_HIT("that the|que la")} THEN 'act' WHEN {_HIT("und der|re of")} THEN 'risk' WHEN {_HIT("the")} THEN 'soft' ELSE 'none' END AS type,
  CASE WHEN {_HIT("that the|que la")} THEN 0.9 WHEN {_HIT("und der|re of")} THEN 0.85 WHEN {_HIT("the")} THEN 0.2 ELSE 0.5 END::DOUBLE AS action,
  CASE WHEN {_HIT("tion of|des")} THEN 1.0 WHEN {_HIT("ing in")} OR doc_id % 9 = 0 THEN 0.9 ELSE 0.0 END::DOUBLE AS near FROM d""")
def desk_weights(t):
    said = F.col("text")
    act = desk.action(said, WORDS)
    locale = F.when(F.col("doc_id") % 9 == 0, "gz")
    return t.documents.select("doc_id", desk.issuer_authority(said, WORDS).alias("issuer"), desk.source_authority(F.col("source"), F.col("lang"), WORDS).alias("authority"), act["type"].alias("type"), act["score"].alias("action"), desk.nearness(said, locale, WORDS).alias("near"))


_FRESH = "datediff('day', {0}, day + 3) BETWEEN 0 AND 1"


@query(f"""
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders), m AS (SELECT k, day, day + CAST(k % 4 AS INT) AS a, CASE WHEN k % 5 > 0 THEN day + CAST(k % 3 + 1 AS INT) END AS h, day + CAST(k % 7 AS INT) AS u FROM o),
f AS (SELECT *, coalesce({_FRESH.format('a')}, false) AS fa, coalesce({_FRESH.format('h')}, false) AS fh, coalesce({_FRESH.format('u')}, false) AS fu FROM m),
g AS (SELECT *, array_to_string(list_filter([CASE WHEN fa THEN 'A股' END, CASE WHEN fh THEN '港股' END, CASE WHEN fu THEN '美股' END], lambda x: x IS NOT NULL), '、') AS fresh, array_to_string(list_filter([CASE WHEN NOT fa THEN 'A股' END, CASE WHEN NOT fh THEN '港股' END, CASE WHEN NOT fu THEN '美股' END], lambda x: x IS NOT NULL), '、') AS stale FROM f)
SELECT k AS o_orderkey, fresh, fresh = '' AS all_stale, CASE WHEN fresh = '' THEN '{desk.ALL_STALE}' WHEN stale <> '' THEN stale || '{desk.SOME_STALE}' ELSE '' END AS note,
  CASE WHEN fresh = '' THEN '{desk.ALL_STALE_SPOKEN}' ELSE array_to_string(list_filter([CASE WHEN stale <> '' THEN stale || '{desk.STALE}' END, CASE WHEN fa THEN 'A股为 ' || month(a) || '月' || day(a) || '日 收盘' END, CASE WHEN fh THEN '港股为 ' || month(h) || '月' || day(h) || '日 收盘' END, CASE WHEN fu THEN '美股为 ' || month(u) || '月' || day(u) || '日 收盘' END], lambda x: x IS NOT NULL), '；') END AS spoken FROM g""")
def market_statuses(t):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    later = lambda n: F.date_add(day, n.cast("int"))
    status = desk.market_status(F.date_add(day, 3), {"a_share": later(k % 4), "hk": F.when(k % 5 > 0, later(k % 3 + 1)), "us": later(k % 7)})
    return t.orders.select("o_orderkey", *(status[c].alias(c) for c in ("fresh", "all_stale", "note", "spoken")))


@query("""
SELECT p_partkey FROM part ORDER BY p_type = 'PROMO' DESC, p_retailprice DESC, p_partkey LIMIT 40""")
def top_in_body(t):
    return executive.top_by_relevance(t.part, F.col("p_type") == "PROMO", [F.desc("p_retailprice"), F.asc("p_partkey")], 40).select("p_partkey")


@query("""
WITH m AS (SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_size > 10 AND p_type <> 'SMALL') ORDER BY k <= 1 DESC, p_retailprice DESC, p_partkey LIMIT 5),
r AS (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' ORDER BY p_retailprice DESC, p_partkey LIMIT 1),
i AS (SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_size > 10 AND p_partkey NOT IN (FROM m UNION ALL FROM r)) ORDER BY k <= 1 DESC, p_retailprice DESC, p_partkey LIMIT 5)
SELECT p_partkey, 'must_read' AS role FROM m UNION ALL SELECT p_partkey, 'risk' FROM r UNION ALL SELECT p_partkey, 'insight' FROM i UNION ALL SELECT * FROM (SELECT p_partkey, 'hero' FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1)""")
def leading_items(t):
    return executive.leading(t.part, "p_partkey", "p_brand", F.col("p_size") > 10, F.col("p_type") == "SMALL", F.col("p_type") == "ECONOMY", [F.desc("p_retailprice"), F.asc("p_partkey")])
