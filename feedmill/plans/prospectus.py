"""Domiciles, cities, institutions and cards of market reports; the rules read whole texts, and the SQL computes them on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions import market, prospectus, text
from feedmill.operators import ranking
from feedmill.plans.registry import query

#: A cover, an issuer and exchanges in syllables that the documents have.
COVER = prospectus.Cover(
    places={"the": "alpha", "that": "beta", "der": "gamma"}, labels={"alpha": ["the"], "delta": ["an"]}, founded=("tion", "ing"), kinds=("er",), under=("in", "of"), article="a",
    limited="re", reach=12, column="and", described="st", at="M", registered=("e", "n"),
)
ISSUER = prospectus.Issuer(own=("the",), traits=("of", "and"), things=("in", "to"), we=("der",), does=("und", "die"), whole=("de",), legal=("la",), group=("that is",), is_=("is",), stands=("on",), alone=("la", "xx"), chinese=("zq",))
EXCHANGES, CITIES, OFFSHORE, NEAR = prospectus.Exchanges(cities=("the",), kind="of", names=("qq",)), ("re", "ou", "st an"), ("ALPHA", "delt"), 30
_PLACE = r"""
t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g') AS t FROM documents), c AS (SELECT *, lower(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS c, regexp_extract(left(t, 2000), 'M([^\s,]{2,12})(?:e|n)', 1) AS w FROM t),
n AS (SELECT *, coalesce(nullif(regexp_extract(left(c, 20000), '(?:tion|ing)(?:er)?(?:in|of)(?:a)?(the|that|der)[^.]{0,12}?re', 1), ''), nullif(regexp_extract(left(c, 800), '(?:tion|ing)(?:er)?(?:in|of)(?:a)?(the|that|der)', 1), ''),
  nullif(regexp_extract(left(c, 20000), '(the|that|der)and', 1), ''), nullif(regexp_extract(left(c, 20000), 'st(?:in|of)(?:a)?(the|that|der)', 1), '')) AS named FROM c),
p AS (SELECT *, coalesce(CASE named WHEN 'the' THEN 'alpha' WHEN 'that' THEN 'beta' WHEN 'der' THEN 'gamma' END, CASE WHEN w = '' THEN NULL WHEN regexp_matches(w, '(?i)the') THEN 'alpha' WHEN regexp_matches(w, '(?i)an') THEN 'delta' ELSE trim(w) END) AS place FROM n)"""


def _said(t):
    """Whole texts with one letter for all that are not ASCII, so that both engines see the same ends of words."""
    return t.documents.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "x").alias("text"))


@query(f"""WITH {_PLACE} SELECT doc_id, place AS domicile, coalesce(contains(lower(place), 'alpha') OR contains(lower(place), 'delt'), false) AS offshore FROM p""")
def domiciles(t):
    rows = _said(t).withColumn("domicile", prospectus.domicile(F.col("text"), COVER))
    return rows.select("doc_id", "domicile", prospectus.is_offshore(F.col("domicile"), OFFSHORE).alias("offshore"))


@query(rf"""WITH {_PLACE}, x AS (SELECT *, regexp_replace(t, '(?i)(?:\b(?:the)\s+)?of|qq', ' ', 'g') AS x FROM p),
s AS (SELECT *, list_transform(string_split(regexp_replace(x, '([.;!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {{'s': s, 'm': regexp_extract(s, '(?is)^(.*?)(\b(?:(?:the)\s+(?:(?:and|of)\s+)*(?:in|to)|(?:that\s+is|der)\s+(?:die|und)|(?:that\s+is|der)\s+(?:is)\s+(?:on)|(?:de)\s+(?:la)|(?:la|xx))\b|(?:zq))', ['a', 'b'])}}) AS s FROM x),
h AS (SELECT doc_id, t, place, x, array_to_string(list_transform(s, lambda y: CASE WHEN y.m.b = '' THEN '' ELSE substr(y.s, greatest(length(y.m.a) - 30, 0) + 1, length(y.m.a) + length(y.m.b) + 30 - greatest(length(y.m.a) - 30, 0)) END), chr(10)) AS near FROM s),
n2 AS (SELECT *, len(regexp_extract_all(lower(x), 'st an|ou|re')) AS mentions, len(regexp_extract_all(lower(near), 'st an|ou|re')) AS hits FROM h)
SELECT doc_id, mentions, hits, CASE WHEN t = '' THEN 'unverified' WHEN hits >= 3 AND (contains(lower(place), 'alpha') OR contains(lower(place), 'delt')) THEN 'redchip' ELSE 'non-redchip' END AS verdict FROM n2""")
def seats(t):
    said = F.col("text")
    return _said(t).select(
        "doc_id", prospectus.city_mentions(said, CITIES, EXCHANGES).cast("long").alias("mentions"), prospectus.city_hits(said, CITIES, NEAR, ISSUER, EXCHANGES).cast("long").alias("hits"),
        prospectus.verdict(said, 3, COVER, ISSUER, CITIES, OFFSHORE, EXCHANGES, NEAR).alias("verdict"),
    )


@query(r"""
WITH m AS (SELECT doc_id, regexp_extract_all(replace(replace(coalesce(text, ''), 'nation', ' '), 'of the', ' '), '([\x{4e00}-\x{9fa5}A-Za-z0-9]{2,12}?(?:tion|ung))', 1) AS found FROM documents),
n AS (SELECT doc_id, list_distinct(list_transform(list_filter(found, lambda n: NOT regexp_matches(n, '^(?:tion|ung)$') AND NOT regexp_matches(n, '^(?:re)?ention$|^The')), lambda n: CASE WHEN regexp_matches(n, '^st') THEN 'Stung' WHEN regexp_matches(n, 'ing') THEN 'Ingung' ELSE n END)) AS names FROM m)
SELECT doc_id, array_to_string(list_sort(names), ',') AS names, len(names) <> 1 OR names[1] IN ('Stung', 'eration') AS kept FROM n""")
def single_institutions(t):
    names = prospectus.institutions(F.col("text"), ["nation", "of the"], ["tion", "ung"], "^(?:re)?ention$|^The", [("^st", "Stung"), ("ing", "Ingung")])
    return t.documents.select("doc_id", names.alias("n")).select("doc_id", F.array_join(F.array_sort("n"), ",").alias("names"), prospectus.keep_unless_single(F.col("n"), ["Stung", "eration"]).alias("kept"))


@query("""
WITH c AS (SELECT p_partkey, p_brand, p_type, p_size, ['up', 'down', 'flat'][p_size % 3 + 1] AS way, p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%' AS named, p_name || ' up' AS second FROM part), d AS (SELECT *, p_brand || ' ' || way || ' ' || p_size || '%' AS first FROM c)
SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' AND way <> 'flat' AND abs(11 - CASE way WHEN 'up' THEN p_size ELSE -p_size END) > 0.05 THEN first || '。' ELSE 'Brand#1收报100点（+1%）。' END AS overview,
  CASE WHEN named THEN '' ELSE first || '|' END || second || CASE WHEN p_type = 'SMALL' THEN '' ELSE '|' || p_type || ' steady' END AS sectors, first AS unquoted FROM d""")
def recap_cards(t):
    way = F.element_at(F.array(F.lit("up"), F.lit("down"), F.lit("flat")), (F.col("p_size") % 3 + 1).cast("int"))
    report = F.concat("p_brand", F.lit(" "), way, F.lit(" "), "p_size", F.lit("%, "), "p_name", F.lit(" up; "), "p_type", F.lit(" steady."))
    clauses = text.split_clauses(report)
    quote = F.struct(F.lit("Brand#1").alias("name"), F.lit("100").alias("value"), F.lit("+1%").alias("change"), F.lit(11.0).alias("pct"))
    card, plain = (market.recap_card(clauses, quotes, ["Brand#1", "Brand#2"], "up", "down", "SMALL") for quotes in (F.array(quote), F.filter(F.array(quote), lambda q: F.lit(False))))
    return t.part.select("p_partkey", card["overview"].alias("overview"), F.array_join(card["sectors"], "|").alias("sectors"), plain["overview"].alias("unquoted"))


@query("""
WITH s AS (SELECT p_partkey, p_brand, CASE coalesce(nullif(p_size % 5, 4), 2) WHEN 3 THEN 10.0::DOUBLE WHEN 2 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN p_type = 'PROMO' THEN 3 ELSE 0 END + CASE p_partkey WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END AS score FROM part)
SELECT p_partkey, score FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) <= 2 ORDER BY score DESC, p_partkey LIMIT 30""")
def must_read(t):
    score = ranking.reading_score(F.nullif(F.col("p_size") % 5, F.lit(4)), F.col("p_type") == "PROMO", F.col("p_partkey") - 1)
    return ranking.all_or_quota(t.part.withColumn("score", score), "p_brand", [F.desc("score"), F.asc("p_partkey")], 30).select("p_partkey", "score")
