"""Scalar rules, further quotas, counts, market wording and data-quality rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedmill.functions import dates, lexicon, market, text, urls
from feedmill.operators import dedupe, memory, merge, ranking, rules, usage
from feedmill.plans.registry import query

_GRAMS = r"list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr({0}, i, 2)))".format(r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))")
_DICE = "2 * len(list_intersect({0}, {1})) / (len({0}) + len({1}))"


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderdate + to_hours((o_orderkey % 3) * 8) AS seen FROM orders)
SELECT o_orderkey, day - 3 AS before, strftime(day, '%m/%d') || ',' || strftime(day - 1, '%m/%d') || ',' || strftime(day - 2, '%m/%d') AS recent, hour(seen) IN (0, 16) AS day_only, CASE WHEN year(day) >= 2000 THEN day END AS in_url,
  greatest(date_diff('day', day, DATE '1999-01-16'), 0) AS clamped, date_diff('day', day, DATE '1999-01-16') AS signed FROM o""")
def calendar(t):
    day, today = F.to_date("o_orderdate"), F.lit("1999-01-16").cast("date")
    at = F.expr("o_orderdate + make_dt_interval(0, cast((o_orderkey % 3) * 8 as int))")
    url = F.concat(F.lit("http://h/a/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/x.html"))
    return t.orders.select(
        "o_orderkey", dates.previous_day(day, 3).alias("before"), F.array_join(dates.recent_mmdd(day, 3), ",").alias("recent"), dates.is_date_only(at).alias("day_only"), urls.date_from_url(url).alias("in_url"),
        dates.clamped_gap(day, today).cast("long").alias("clamped"), dates.signed_gap(day, today).cast("long").alias("signed"),
    )


@query(f"""
SELECT item_id, round(greatest({_DICE.format(_GRAMS.format('text'), _GRAMS.format('substr(text, 1, 60)'))}, {_DICE.format(_GRAMS.format('text'), _GRAMS.format("'the quick brown fox'"))}), 6) AS best,
  CASE WHEN length(regexp_replace(text, '\\s+', '', 'g')) > 80 THEN lower(regexp_replace(text, '\\s+', '', 'g')) ELSE '' END AS body, substr(regexp_replace(text, '\\s+', '', 'g'), 1, 16) AS title_key,
  trim(substr(text, 5)) AS bare, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[.,;:!?\\n，。；：！？、]+'), lambda c: trim(c, ' ')), lambda c: c <> ''), '|') AS clauses FROM benchmark""")
def wording(t):
    x = F.col("text")
    best = text.best_dice(x, F.array(F.substring(x, 1, 60), F.lit("the quick brown fox")))
    bare = text.without_prefix(F.concat(F.lit("pre:"), F.substring(x, 5, 1 << 20)), "pre:")
    return t.benchmark.select("item_id", F.round(best, 6).alias("best"), text.content_fingerprint(x).alias("body"), text.title_key(x).alias("title_key"), bare.alias("bare"), F.array_join(text.split_clauses(x), "|").alias("clauses"))


@query(r"""
WITH p AS (SELECT p_partkey, p_name || ', ' || p_type || '; ' || p_brand || ', rest' AS x, p_name AS a, p_type || ' ' || p_name AS b, p_partkey * 977 AS n FROM part), c AS (SELECT *, substr(x, 1, 22) AS cut FROM p),
k AS (SELECT *, length(regexp_extract(cut, '([,;][^,;]*)$', 1)) AS tail FROM c)
SELECT p_partkey, CASE WHEN length(x) <= 22 THEN x WHEN tail > 0 AND 22 - tail >= 11 THEN substr(cut, 1, 22 - tail) ELSE cut END AS clipped, length(a) AS span,
  CASE WHEN n / 1.5 >= 1e6 THEN printf('%.1fM', round(n / 1.5 / 1e6, 1)) WHEN n / 1.5 >= 1e3 THEN printf('%.1fK', round(n / 1.5 / 1e3, 1)) ELSE CAST(CAST(round(n / 1.5, 0) AS BIGINT) AS VARCHAR) END AS tokens FROM k""")
def clips_and_spans(t):
    x = F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit("; "), F.col("p_brand"), F.lit(", rest"))
    return t.part.select("p_partkey", text.clip_at_clause(x, 22, ",;").alias("clipped"), text.longest_common_span(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")).cast("long").alias("span"), text.format_tokens(F.col("p_partkey") * 977).alias("tokens"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS block, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'quota' WHEN 'view' THEN 'auth' ELSE 'other' END AS error FROM events""")
def salvaged_json(t):
    noisy = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("cut "), F.expr("substring(props, 1, length(props) - 1)"))).when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(' and {"b": 2}'))).otherwise(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    said = F.when(F.col("event_type") == "error", "request timed out").when(F.col("event_type") == "click", "HTTP 429: slow down").when(F.col("event_type") == "view", "401 Unauthorized").otherwise("broken")
    return t.events.select("event_id", text.first_json(noisy).alias("block"), usage.classify_error(said).alias("error"))


@query(r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host, true AS same, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages""")
def link_parts(t):
    other = F.concat(F.col("url"), F.when(F.contains("url", F.lit("#")), F.lit("x")).when(F.contains("url", F.lit("?")), F.lit("&utm_medium=m")).otherwise(F.lit("?utm_medium=m")))
    return t.pages.select("page_id", F.coalesce(urls.host(F.col("url")), F.lit("")).alias("host"), urls.same_url(F.col("url"), other).alias("same"), F.coalesce(urls.query_parameter(F.col("url"), "page"), F.lit("")).alias("page"))


@query("""
SELECT p_partkey, array_to_string(list_distinct(list_concat([p_type, p_brand], list_filter([CASE p_type WHEN 'PROMO' THEN 'sales' WHEN 'ECONOMY' THEN 'value' WHEN 'SMALL' THEN 'value' END, CASE p_brand WHEN 'Brand#1' THEN 'own' END], lambda x: x IS NOT NULL))).list_sort(), ',') AS tags,
  regexp_matches(p_name, '(?i)bolt') OR (regexp_matches(p_name, '(?i)ring|plate') AND regexp_matches(p_name, '(?i)red|blue')) AS policy, CASE WHEN regexp_matches(p_name, '(?i)hot') THEN 0.0::DOUBLE WHEN regexp_matches(p_name, '(?i)bolt') THEN 0.95::DOUBLE WHEN regexp_matches(p_name, '(?i)ring') THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS issuer FROM part""")
def tags_and_issuers(t):
    name = F.col("p_name")
    tags = text.mapped_tags(F.array("p_type", "p_brand"), {"PROMO": "sales", "ECONOMY": "value", "SMALL": "value", "Brand#1": "own"})
    issuer = lexicon.vetoed(lexicon.first_value(name, [(["bolt"], 0.95), (["ring"], 0.8)]), name, ["hot"])
    return t.part.select("p_partkey", F.array_join(F.array_sort(tags), ",").alias("tags"), lexicon.guarded(name, ["bolt"], ["ring", "plate"], ["red", "blue"]).alias("policy"), issuer.alias("issuer"))


@query("""
SELECT event_id, event_type FROM events ORDER BY CAST(ts AS DATE) = DATE '2024-01-20' DESC, ts, event_id LIMIT 500""")
def first_today(t):
    return ranking.take_first_today(t.events, F.to_date("ts") == F.lit("2024-01-20").cast("date"), ["ts", "event_id"], 500).select("event_id", "event_type")


@query("""
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type = 'PROMO' DESC, p_size % 3, p_size % 5 DESC, p_retailprice DESC, p_partkey) AS place FROM part""")
def tier_and_time(t):
    out = ranking.by_tier_and_time(t.part, ["p_brand"], F.col("p_type") == "PROMO", F.col("p_size") % 3, F.col("p_size") % 5, F.col("p_retailprice"), "p_partkey")
    return out.select("p_partkey", F.col("place").cast("long").alias("place"))


@query("""
WITH v AS (SELECT *, coalesce(CASE WHEN p_size > 40 THEN 3 WHEN p_size > 10 THEN 1 END, 2) * 10 + CASE WHEN p_brand = 'Brand#1' THEN 5 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 3 ELSE 0 END AS score FROM part)
SELECT p_name, p_partkey, CAST(score AS INTEGER) AS score FROM v QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY score DESC, p_partkey) = 1""")
def best_by_value(t):
    score = ranking.value_score(F.when(F.col("p_size") > 40, 3).when(F.col("p_size") > 10, 1), F.col("p_brand") == "Brand#1", F.col("p_type") == "PROMO")
    return ranking.best_per_group(t.part.withColumn("score", score), ["p_name"], score, ["p_partkey"]).select("p_name", "p_partkey", F.col("score").cast("int").alias("score"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) SELECT p_partkey, p_brand FROM r ORDER BY k <= 2 DESC, p_size DESC, p_partkey LIMIT 80""")
def balanced_brands(t):
    return ranking.balanced_pick(t.part, "p_brand", [F.desc("p_size"), "p_partkey"], 80, 2).select("p_partkey", "p_brand")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, (SELECT greatest(max(o_orderdate), max(o_orderdate - INTERVAL 3 DAY)) FROM orders) AS latest FROM orders""")
def changes_in_order(t):
    rows = t.orders.withColumn("other", F.expr("o_orderdate - interval 3 days"))
    latest = usage.latest_at(rows, ["o_orderdate", "other"])
    return usage.in_order(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).join(F.broadcast(latest)).select("o_orderkey", F.col("place").cast("long").alias("place"), "latest")  # one row


@query("""
WITH b AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS repeats FROM events GROUP BY 1), v AS (SELECT user_id, event_id, length(event_type) + CAST(value AS BIGINT) % 7 * 20 AS score, ts FROM events)
SELECT v.user_id, b.repeats, v.event_id FROM v JOIN b USING (user_id) QUALIFY row_number() OVER (PARTITION BY v.user_id ORDER BY score DESC, ts, event_id) = 1""")
def best_versions(t):
    score = F.length("event_type") + F.rint("value").cast("long") % 7 * 20
    best = ranking.best_per_group(t.events, ["user_id"], score, ["ts", "event_id"]).select("user_id", "event_id")
    return best.join(t.events.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("repeats")), "user_id")


@query("""
WITH l AS (SELECT p_partkey, unnest(list_filter([CASE WHEN regexp_matches(p_name, '(?i)bolt|nut') THEN 'fasteners' END, CASE WHEN regexp_matches(p_name, '(?i)plate') THEN 'flat' END, CASE WHEN regexp_matches(p_name, '(?i)zinc') THEN 'zinc' END], lambda x: x IS NOT NULL)) AS line FROM part)
SELECT n.line, count(p_partkey) AS n, coalesce(array_to_string(list_sort(list(p_partkey) FILTER (WHERE p_partkey IS NOT NULL))[1:2], ','), '') AS examples FROM (SELECT unnest(['fasteners', 'flat', 'zinc']) AS line) n LEFT JOIN l ON n.line = l.line GROUP BY n.line""")
def product_coverage(t):
    lines = lexicon.all_matches(F.col("p_name"), {"fasteners": ["bolt", "nut"], "flat": ["plate"], "zinc": ["zinc"]})
    out = usage.coverage(t.part, "p_partkey", lines, ["fasteners", "flat", "zinc"])
    return out.select("line", "n", F.coalesce(F.array_join(F.col("examples").cast("array<string>"), ","), F.lit("")).alias("examples"))


_SAID = """s AS (SELECT o_orderkey, 'Alpha Index ' || CASE WHEN o_orderkey % 2 = 0 THEN 'rose ' ELSE 'fell ' END || printf('%.2f', o_orderkey % 300 / 100) || '%' AS one, 'Beta closed at ' || (o_orderkey % 9) || '%' AS two FROM orders)"""


@query(f"""
WITH {_SAID}, m AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * CAST(printf('%.2f', o_orderkey % 300 / 100) AS DOUBLE) AS pct FROM s)
SELECT o_orderkey, 'Alpha Index:' || CAST(round(pct, 2) AS VARCHAR) AS moves, abs(1.5::DOUBLE - pct) > 0.05 AS conflict, false AS move_only, o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 AS recap FROM m""")
def market_moves(t):
    key = F.col("o_orderkey")
    one = F.concat(F.lit("Alpha Index "), F.when(key % 2 == 0, "rose ").otherwise("fell "), F.format_string("%.2f", key % 300 / 100), F.lit("%"))
    clauses = F.array(one, F.concat(F.lit("Beta closed at "), key % 9, F.lit("%")))
    moves = market.index_moves(clauses, ["Alpha Index", "Beta"], "rose|up", "fell|down")
    quotes = F.array(F.struct(F.lit("Alpha").alias("name"), F.lit(1.5).alias("pct")))
    title = F.concat(F.when(key % 3 == 0, "closing report").otherwise("report"), F.when(key % 2 == 0, " midday").otherwise(""))
    return t.orders.select(
        "o_orderkey", F.array_join(F.transform(moves, lambda m: F.concat(m["name"], F.lit(":"), F.round(m["pct"], 2).cast("string"))), ",").alias("moves"), market.conflicts(moves, quotes).alias("conflict"),
        market.is_move_only(F.concat(one, F.lit(" on the day")), ["Alpha Index", "Beta"]).alias("move_only"), market.is_recap(title, "closing", "midday").alias("recap"),
    )


@query(r"""
WITH n AS (SELECT event_id, list_filter(list_distinct(regexp_extract_all(event_type || ' ' || (event_id % 500) || ' for ' || user_id, '\d{2,}')), lambda x: NOT list_contains(regexp_extract_all(props || ' ' || user_id, '\d{2,}'), x)) AS missing FROM events)
SELECT 'numbers' AS rule, 'block' AS level, CAST(event_id AS VARCHAR) AS key, array_to_string(missing, ',') AS detail FROM n WHERE len(missing) > 0""")
def numbers_without_source(t):
    rows = t.events.withColumn("said", F.concat_ws(" ", "event_type", F.col("event_id") % 500, F.lit("for"), "user_id")).withColumn("source", F.concat_ws(" ", "props", "user_id"))
    return rules.unsupported_numbers(rows, "said", "source", "event_id")


@query(f"""
WITH g AS (SELECT s_suppkey AS id, {_GRAMS.format("(s_name || s_nationkey)")} AS g FROM supplier), p AS (SELECT a.id AS u, b.id AS v, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s FROM g a JOIN g b ON a.id < b.id)
SELECT 'alike' AS rule, 'warn' AS level, CAST(u AS VARCHAR) AS key, CAST(v AS VARCHAR) AS detail FROM p WHERE s > 0.85""")
def alike_names(t):
    return rules.alike(t.supplier, text.title_bigrams(F.concat("s_name", F.col("s_nationkey").cast("string"))), "s_suppkey", 0.85)


@query("""
WITH w AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'own' END AS note, s_nationkey FROM supplier), i AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
SELECT w.s_suppkey, coalesce(nullif(trim(note), ''), CASE WHEN n_name IS NOT NULL AND n_regionkey <> 2 THEN n_name END) AS note FROM w LEFT JOIN nation ON s_nationkey = n_nationkey WHERE w.s_suppkey NOT IN (SELECT s_suppkey FROM i)""")
def filled_and_unblocked(t):
    rows = t.supplier.withColumn("note", F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 2, "own"))
    other = t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("note"))
    bad = rules.foreign_key(t.supplier, "s_acctbal", t.supplier.where("s_acctbal >= 0"), "s_acctbal", "s_suppkey")
    out = merge.fill_missing(rows, other, "s_nationkey", "note").withColumn("note", F.nullif("note", F.lit("")))
    return rules.drop_blocked(out, "s_suppkey", bad).select("s_suppkey", "note")


@query("""
WITH a AS (SELECT c_nationkey AS k, list_distinct(list(c_mktsegment)) AS x FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, list_distinct(list(CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'BUILDING' END)) AS y FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS nation, array_to_string(list_sort(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))), ',') AS both FROM a FULL JOIN b ON a.k = b.k""")
def united_sets(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_set("c_mktsegment").alias("both"))  # segments are few
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.collect_set(F.when(F.col("s_acctbal") < 0, "debt").otherwise("BUILDING")).alias("both"))
    return merge.union_arrays(a, b, "nation", "both").select("nation", F.array_join("both", ",").alias("both"))


@query("""
WITH x AS (SELECT 0 AS f, c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 1, s_suppkey, s_nationkey FROM supplier), w AS (SELECT nation, id, f FROM x QUALIFY row_number() OVER (PARTITION BY nation ORDER BY f, id) = 1)
SELECT nation, id, CASE WHEN nation % 4 = 0 THEN 'fresh' ELSE 'stored' END AS side FROM w""")
def first_by_priority(t):
    a = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    out = merge.priority_union([a, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))], "nation", ["id"]).select("nation", "id", F.lit("stored").alias("side"))
    return merge.replace_partition(out, out.where("nation % 4 = 0").withColumn("side", F.lit("fresh")), "nation")


@query("""
WITH c AS (SELECT p_partkey AS pos, p_name AS leader, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END AS tier, p_size AS score FROM part), o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY leader, tier ORDER BY score DESC, pos) = 1)
SELECT pos FROM o QUALIFY row_number() OVER (PARTITION BY leader ORDER BY tier, score DESC, pos) <= 2""")
def kept_per_theme(t):
    rows = t.part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("leader"), "p_type", "p_size")
    rank = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(2)
    return dedupe.keep_per_theme(rows, rank, F.col("p_size"), 2).select("pos")


@query("""
WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS used, list(ts) AS times FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-28' GROUP BY user_id)
SELECT user_id, list_filter(['view', 'purchase', 'click', 'error'], lambda a: NOT list_contains(used, a))[1] AS next_angle FROM u WHERE len(list_filter(times, lambda x: (x BETWEEN TIMESTAMP '2024-01-28 06:00:00' AND TIMESTAMP '2024-01-29 18:00:00'))) > 0""")
def next_angle(t):
    rows = t.events.where("to_date(ts) >= date'2024-01-28'").groupBy("user_id").agg(F.collect_set("event_type").alias("used"), F.collect_list(F.struct(F.col("ts").alias("at"))).alias("samples"))  # a user's last days
    low, high = (F.to_timestamp_ntz(F.lit(x)) for x in ("2024-01-28 06:00:00", "2024-01-29 18:00:00"))
    out = memory.filter_samples(rows, "samples", low, high)
    return out.select("user_id", ranking.next_unused(F.array(*map(F.lit, ["view", "purchase", "click", "error"])), F.col("used")).alias("next_angle"))


@query("""
WITH g AS (SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'price' WHEN o_orderstatus = 'P' THEN 'status' END AS gate FROM orders) SELECT coalesce(gate, 'kept') AS gate, count(*) AS n FROM g GROUP BY 1""")
def gate_losses(t):
    from feedmill.operators.normalize import counted

    out = counted(t.orders, {"price": F.col("o_totalprice") >= 100000, "status": F.col("o_orderstatus") != "P"})
    return out.groupBy(F.coalesce("dropped_by", F.lit("kept")).alias("gate")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN h <= 24 THEN 1.0::DOUBLE WHEN h <= 48 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS factor, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS first_seen FROM (SELECT *, date_diff('second', o_orderdate, TIMESTAMP '1999-01-16 12:00:00') / 3600 AS h FROM orders)""")
def timeliness(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.withColumn("first_seen", F.lag("o_orderdate").over(w).isNull())
    return rows.select("o_orderkey", dates.age_factor(F.col("o_orderdate"), F.to_timestamp_ntz(F.lit("1999-01-16 12:00:00"))).alias("factor"), "first_seen")
