"""Candidates for a listing over the driver's tables; the rules read words that the tables have, and the SQL computes them on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions import listings
from feedmill.operators import listings as candidates
from feedmill.plans.registry import query


def _dealt(key: str, values: list[str | None]):
    """The value of a row by its key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql(key: str, values: list) -> str:
    """The same as SQL."""
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in values) + f"][CAST({key} % {len(values)} + 1 AS BIGINT)]"


#: Rules on listings in words that the documents, parts and orders have.
WORDS = listings.Listing(
    stages={"done": ("tion of", "that the"), "begun": ("und der", "the re"), "planned": ("de la",)}, hints=("of the", "der", "que"), first="planned", routine="planned-routine", report="the[^,.;|]{0,4}in", issue=r"on\s*([a-e]+)\s*re",
    numbered=("no ", "."), ongoing="running", region=("the", "del"), coming=("that the", "tion of"), finance=("ing in", "en un"), events=("und",), abroad=("src1$",), hong_kong=("src2",), province_names="^en$",
)
NAMES = listings.Listing(
    colon=":", places=("small", "red", "hot"), place_ends=" ", tail_boards=("big",), tail_words=("old",), tail_stages=("ring", "gear"), legal_forms=("bolt", "widget"), plans="for", boards={"east": ("eco",), "west": ("pro", "sma")},
    industries={"metal": ("bolt", "gear"), "flat": ("plate",)}, registered_at="seat", province="Brand", city=r"(#1\d)", status="status",
)
_TEXTS = "d AS (SELECT doc_id, doc_id % 5 AS five, source, lang, coalesce(text, '') AS t, coalesce(text, '') || ' ' || coalesce(source, '') AS j FROM documents)"
_INFERRED = "CASE WHEN regexp_matches(j, '(?i)tion of|that the') THEN 'done' WHEN regexp_matches(j, '(?i)und der|the re') THEN 'begun' ELSE 'planned' END"
_STAGE = f"CASE WHEN regexp_matches(j, '(?i)of the|der|que') THEN {_INFERRED} ELSE '' END"
_ISSUE = r"CASE WHEN NOT regexp_matches(j, 'the[^,.;|]{0,4}in') THEN '' WHEN regexp_extract(j, 'on\s*([a-e]+)\s*re', 1) = '' THEN 'running' ELSE 'no ' || regexp_extract(j, 'on\s*([a-e]+)\s*re', 1) || '.' END"


@query(f"""
WITH {_TEXTS}, s AS (SELECT *, {_INFERRED} AS inferred, {_STAGE} AS plain, {_ISSUE} AS issue FROM d)
SELECT doc_id, inferred, CASE WHEN plain = 'planned' AND issue <> '' THEN 'planned-routine' ELSE plain END AS shown, issue, inferred = 'planned' AND issue <> '' AS routine, CASE WHEN five = 0 THEN 'done' ELSE plain END AS stage FROM s""")
def listing_stages(t):
    title, summary, none = F.col("text"), F.col("source"), F.lit(None).cast("string")
    given = F.when(F.col("doc_id") % 5 == 0, "done").otherwise("other")
    return t.documents.select(
        "doc_id", listings.infer_stage(title, summary, WORDS).alias("inferred"), listings.display_stage(none, title, summary, WORDS).alias("shown"), listings.report_issue(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))), WORDS).alias("issue"),
        listings.is_routine(title, summary, WORDS).alias("routine"), listings.stage_of(given, title, summary, WORDS).alias("stage"),
    )


@query(r"""
WITH p AS (SELECT p_partkey, p_name || ' (for ' || p_type || ' )' || CASE WHEN p_size % 3 = 0 THEN ' bigold ring' ELSE '' END || ': ' || p_brand || ' (' || p_size || ')' AS title, 'seat: ' || p_brand || '| status: ' || p_type AS summary FROM part),
c AS (SELECT *, trim(regexp_replace(regexp_replace(split_part(title, ':', 1), '\([^)]*\)', '', 'g'), '\s+', ' ', 'g')) AS company, trim(regexp_extract(title, 'for\s*([^)]+?)\s*\)', 1)) AS board FROM p),
n AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(company, '(?:big)?(?:old)?(?:ring|gear)$', '')), '^(?:small|red|hot)(?: )?', '')), '(?:bolt|widget)$', '')) AS cut FROM c)
SELECT p_partkey, company, CASE WHEN cut = '' THEN company ELSE cut END AS short, coalesce(nullif(regexp_extract(regexp_replace(trim(regexp_extract(summary, 'seat:\s*([^|]+)', 1)), '^Brand(?: )?', ''), '(#1\d)', 1), ''), 'Brand') AS city, board,
  CASE WHEN regexp_matches(board, '(?i)eco') THEN 'east' WHEN regexp_matches(board, '(?i)pro|sma') THEN 'west' ELSE '' END AS exchange, CASE WHEN regexp_matches(company, '(?i)bolt|gear') THEN 'metal' WHEN regexp_matches(company, '(?i)plate') THEN 'flat' ELSE '' END AS industry,
  trim(regexp_extract(title, ':\s*([^(]+)', 1)) AS progress FROM n""")
def listing_names(t):
    title = F.concat("p_name", F.lit(" (for "), "p_type", F.lit(" )"), F.when(F.col("p_size") % 3 == 0, " bigold ring").otherwise(""), F.lit(": "), "p_brand", F.lit(" ("), F.col("p_size"), F.lit(")"))
    rows = t.part.select("p_partkey", "p_type", title.alias("title"), F.concat(F.lit("seat: "), "p_brand", F.lit("| status: "), "p_type").alias("summary"))
    company, board = listings.company_name(F.col("title"), NAMES), listings.planned_board(F.col("title"), NAMES)
    return rows.select("p_partkey", company.alias("company"), listings.short_name(F.col("title"), NAMES).alias("short"), listings.city_of(F.col("summary"), NAMES).alias("city"), board.alias("board"), listings.board_exchange(board, NAMES).alias("exchange"),
                       listings.industry(company, NAMES).alias("industry"), listings.progress(F.col("title"), F.col("summary"), NAMES).alias("progress"))


@query(f"""
WITH {_TEXTS}, f AS (SELECT *, CASE WHEN five = 1 THEN lang WHEN five = 2 THEN '' END AS province, regexp_matches(j, '(?i)that the|tion of') AND NOT regexp_matches(j, '(?i)ing in|en un') AS coming, regexp_matches(j, '(?i)ing in|en un') AND NOT regexp_matches(j, '(?i)und') AS finance, (doc_id * 7919) % 1000000 AS code FROM d),
k AS (SELECT *, CASE WHEN coalesce(province, '') <> '' THEN regexp_matches(province, '(?i)^en$') ELSE doc_id % 4 = 0 OR regexp_matches(j, '(?i)the|del') END AS keep,
  CASE WHEN regexp_matches(source, '(?i)src1$') THEN 'overseas' WHEN regexp_matches(source, '(?i)src2') THEN 'hkex' WHEN code // 100000 < 3 THEN 'low' WHEN code // 10000 BETWEEN 80 AND 84 THEN 'high' END AS market FROM f),
s AS (SELECT *, CASE WHEN coming THEN 'ipo-tutoring' WHEN NOT finance THEN market END AS sub FROM k)
SELECT doc_id, CASE WHEN NOT keep THEN 'drop' WHEN sub IS NULL THEN 'finance' ELSE 'keep' END AS action, CASE WHEN keep THEN sub END AS sub FROM s""")
def listing_decisions(t):
    key, none = F.col("doc_id"), F.lit(None).cast("string")
    code = F.lpad((key * 7919 % 1_000_000).cast("string"), 6, "0")
    province = F.when(key % 5 == 1, F.col("lang")).when(key % 5 == 2, "")
    found = listings.decide(F.col("text"), F.col("source"), none, F.col("source"), code, province, key % 4 == 0, {"low": ("0", "1", "2"), "high": ("80", "81", "82", "83", "84")}, WORDS)
    return t.documents.select("doc_id", found["action"].alias("action"), found["sub"].alias("sub"))


#: What is done, begun and to come in a text of a part.
GROWN = listings.Listing(landed=("ring", "bolt"), under_way=("gear", "plate"), to_come=("PROMO", "red", "#1"), near=8)


@query("""
WITH t AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_name || ' ' || p_brand AS t FROM part), i AS (SELECT p_partkey, t, unnest(range(1, length(t) + 1)) AS i FROM t),
w AS (SELECT p_partkey, i, w, done FROM i, (VALUES ('ring', true), ('bolt', true), ('gear', false), ('plate', false)) v(w, done) WHERE substr(t, i, length(w)) = w
  AND NOT EXISTS (SELECT 1 FROM (VALUES ('PROMO'), ('red'), ('#1')) m(m) WHERE contains(substr(t, greatest(i - 8, 1), least(8, i - 1)), m) OR contains(substr(t, i + length(w), 8), m))),
b AS (SELECT p_partkey, done, min_by(w, i) AS w FROM w GROUP BY ALL)
SELECT t.p_partkey, CASE WHEN d.w IS NOT NULL THEN 'landed' WHEN u.w IS NOT NULL THEN 'progress' ELSE 'clue' END AS stage, coalesce(d.w, u.w) AS evidence FROM t LEFT JOIN b d ON t.p_partkey = d.p_partkey AND d.done LEFT JOIN b u ON t.p_partkey = u.p_partkey AND NOT u.done""")
def listing_maturity(t):
    found = listings.maturity(F.concat_ws(" ", "p_name", "p_type", "p_name", "p_brand"), GROWN)
    return t.part.select("p_partkey", found["stage"].alias("stage"), found["evidence"].alias("evidence"))


REGISTER = listings.Listing(first="open", coach={"F": "done", "O": "listed"}, withdrawn="P", report_on="LOW")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'listed' ELSE 'open' END AS stage FROM orders WHERE NOT contains(o_orderstatus, 'P') AND NOT contains(o_orderpriority, 'LOW')")
def listing_register(t):
    return t.orders.where(listings.coach_kept(F.col("o_orderstatus"), F.col("o_orderpriority"), REGISTER)).select("o_orderkey", listings.coach_stage(F.col("o_orderstatus"), REGISTER).alias("stage"))


def _offered(t):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int"))
    company = F.when(F.col("o_custkey") % 50 == 0, None).otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    return t.orders.select("o_orderkey", company.alias("company"), day.alias("day"), _dealt("o_orderkey", [*listings.WORTH, "", None]).alias("stage"), (F.col("o_custkey") % 7 == 0).alias("raised"))


_OFFERED = f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 50 <> 0 THEN 'C' || o_custkey END AS company, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS day, {_sql("o_orderkey", [5, 4, 3, 2, 1, 0, 0])} + CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 0 END AS score FROM orders),
b AS (SELECT * FROM o WHERE day >= DATE '2024-01-20' AND (company IS NULL OR company NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_nationkey = 3))
  QUALIFY row_number() OVER (PARTITION BY coalesce(company, '#' || o_orderkey) ORDER BY score DESC, day DESC, o_orderkey) = 1)"""


def _best(t):
    told = t.customer.where("c_nationkey = 3").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("company"))
    return candidates.candidates(_offered(t), "stage", "raised", "company", "day", "o_orderkey", told, F.lit("2024-01-20").cast("date"))


@query(_OFFERED + "SELECT o_orderkey, company, score FROM b")
def listing_candidates(t):
    return _best(t).select("o_orderkey", "company", "score")


@query(_OFFERED + "SELECT o_orderkey, company, score FROM b ORDER BY score DESC, day DESC, o_orderkey LIMIT 3")
def listing_top(t):
    return candidates.top(_best(t), "day", "o_orderkey").select("o_orderkey", "company", "score")
