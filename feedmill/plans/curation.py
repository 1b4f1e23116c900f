"""Windows, quotas, merges and counts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions import dates, text, urls
from feedmill.operators import joins, merge, normalize, ranking, usage
from feedmill.plans.registry import query

#: Days that stand for "today" over tables that end in the past.
EVENTS_TODAY, ORDERS_TODAY = "2024-01-30", "1999-01-16"


def _today(day):
    return F.to_date(F.lit(day))


@query("""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
kept AS (SELECT * FROM ranked WHERE r <= 20 ORDER BY n_chars DESC, doc_id LIMIT 200),
came AS (SELECT source, count(*) AS inflow FROM documents GROUP BY source),
stay AS (SELECT source, count(*) AS kept, avg(n_chars) AS avg_score FROM kept GROUP BY source)
SELECT coalesce(c.source, s.source) AS source, c.inflow, coalesce(s.kept, 0) AS kept, round(coalesce(s.kept, 0) / c.inflow, 6) AS ratio, round(s.avg_score, 4) AS avg_score
FROM came c LEFT JOIN stay s ON c.source = s.source""")
def source_yield(t):
    docs = t.documents
    kept = ranking.interleaved_quota(docs, "source", [F.desc("n_chars"), "doc_id"])
    out = usage.source_yield(docs, kept, "source", "n_chars")
    return out.select("source", "inflow", "kept", F.round("ratio", 6).alias("ratio"), F.round("avg_score", 4).alias("avg_score"))


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE date_diff('day', CAST(ts + INTERVAL 8 HOUR AS DATE), DATE '2024-01-30') BETWEEN 0 AND 1 GROUP BY event_type""")
def window_calendar_days(t):
    out = normalize.in_window(t.events, "ts", _today(EVENTS_TODAY), 2)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
SELECT o_orderpriority, count(*) AS n FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-16') BETWEEN 0 AND 7 GROUP BY o_orderpriority""")
def window_day_gap(t):
    return t.orders.where(dates.within_gap(F.to_date("o_orderdate"), _today(ORDERS_TODAY), 7)).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events)
SELECT CASE date_diff('day', day, DATE '2024-01-30') WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' WHEN 2 THEN 'two days ago' ELSE strftime(day, '%m/%d') END AS label, count(*) AS n,
  max(CASE WHEN dayofweek(day) IN (6, 0, 1) THEN 1 ELSE 0 END) AS weekend FROM d GROUP BY 1""")
def relative_day_label(t):
    day = dates.date_key(F.col("ts"))
    out = t.events.select(dates.relative_day(day, _today(EVENTS_TODAY)).alias("label"), dates.is_weekend_edition(day).cast("int").alias("weekend"))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.max("weekend").alias("weekend"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) - CASE dayofweek(o_orderdate) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS DATE) AS previous,
  CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-16'), 0) AS back FROM orders""")
def trading_days(t):
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", day.alias("day"), dates.previous_trading_day(day).alias("previous"), dates.weekday(day).cast("int").alias("weekday"), dates.clamped_gap(day, _today(ORDERS_TODAY)).cast("long").alias("back"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT doc_id, source, n_chars FROM r WHERE k <= 20 ORDER BY n_chars DESC, doc_id LIMIT 200""")
def quota_interleaved(t):
    return ranking.interleaved_quota(t.documents.select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"])


@query("""
WITH best AS (SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM best) SELECT doc_id, source, n_chars FROM r WHERE k <= 8""")
def quota_topn_then_cap(t):
    return ranking.top_then_quota(t.documents.select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"])


@query("""
WITH r AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT doc_id, source, lang, n_chars FROM r WHERE coalesce(lang <> 'en', true)

UNION ALL SELECT doc_id, source, lang, n_chars FROM (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE lang = 'en') WHERE k <= 5""")
def quota_subset(t):
    return ranking.cap_subset(t.documents.select("doc_id", "source", "lang", "n_chars"), "source", F.col("lang") == "en", [F.desc("n_chars"), "doc_id"], 5)


@query("""
WITH a AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
b AS (SELECT doc_id, lang, source, n_chars, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM a WHERE k <= 4) SELECT * FROM b WHERE rank <= 18""")
def section_ranks(t):
    return ranking.section_ranks(t.documents.select("doc_id", "lang", "source", "n_chars"), "lang", "source", [F.desc("n_chars"), "doc_id"])


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS k, l_partkey FROM lineitem),
n AS (SELECT *, sum(CASE WHEN k > 10 AND l_quantity >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY k) AS nth FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM n WHERE k <= 10 OR (l_quantity >= 40 AND nth <= 4)""")
def cap_with_exemption(t):
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return ranking.cap_with_exemption(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), "l_suppkey", "l_quantity", order, 10, 40, 4)


@query("""
WITH here AS (SELECT count(*) AS n FROM part WHERE p_type = 'ECONOMY' AND p_size >= 50),
secs AS (SELECT p_partkey, p_size, CASE WHEN p_type = 'ECONOMY' AND p_size >= 50 THEN 'lead' ELSE p_type END AS section FROM part),
best AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS k FROM secs WHERE section <> 'lead' AND p_size >= 45)
SELECT s.p_partkey, s.p_size, CASE WHEN b.p_partkey IS NOT NULL THEN 'lead' ELSE section END AS section
FROM secs s LEFT JOIN (SELECT best.p_partkey FROM best, here WHERE k <= 60 - n) b ON s.p_partkey = b.p_partkey""")
def floor_refill(t):
    rows = t.part.select("p_partkey", "p_size", F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") >= 50), "lead").otherwise(F.col("p_type")).alias("section"))
    return ranking.floor_refill(rows, "section", "lead", F.col("p_size") >= 45, [F.desc("p_size"), "p_partkey"], 60)


_TIERED = """
SELECT p_partkey, p_brand, p_type, p_retailprice, CASE WHEN r <= 3 THEN 3 WHEN r > n - ceil(n * 0.7) THEN 1 ELSE 2 END AS importance FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"""


def _tiered(t):
    rows = t.part.select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return ranking.importance_tiers(rows, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"])


@query(_TIERED)
def importance_tiers(t):
    return _tiered(t)


@query(f"""
WITH tiers AS ({_TIERED}), spot AS (SELECT *, sum(CASE WHEN importance = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM tiers),
first AS (SELECT p_partkey FROM spot WHERE importance = 3 AND k <= 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 3)
SELECT p_partkey, p_brand, p_type, p_retailprice, CASE WHEN importance = 3 AND p_partkey NOT IN (SELECT p_partkey FROM first) THEN 2 ELSE importance END AS importance FROM spot""")
def limit_level(t):
    return ranking.limit_level(_tiered(t), "p_brand", [F.desc("p_retailprice"), "p_partkey"]).select("p_partkey", "p_brand", "p_type", "p_retailprice", "importance")


@query(f"""
WITH tiers AS ({_TIERED}) SELECT p_partkey, p_type, importance, CAST(row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END DESC, importance DESC, p_partkey) AS INTEGER) AS rank FROM tiers""")
def final_ranks(t):
    return ranking.final_ranks(_tiered(t), "p_type", F.col("p_brand") == "Brand#1", ["p_partkey"]).select("p_partkey", "p_type", "importance", "rank")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM r WHERE n <= 5 OR k <= 2 OR k > n - 3""")
def head_and_tail(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return ranking.head_and_tail(rows, ["o_custkey"], ["day", "o_orderkey"], 5)


@query("""
SELECT o.o_orderkey, c.c_name, n.n_name, coalesce(c.c_mktsegment, 'unknown') AS segment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def enrich_left_lookup(t):
    out = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("o_orderkey", "c_name", "n_name", F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate >= TIMESTAMP '1999-01-01')")
def anti_seen(t):
    return t.customer.join(t.orders.where("o_orderdate >= TIMESTAMP '1999-01-01'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
SELECT o.o_orderkey, o.o_orderstatus, max(l.l_shipdate) IS NOT NULL AS listed, CAST(max(l.l_shipdate) AS DATE) AS listed_on FROM orders o
LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate >= o.o_orderdate GROUP BY o.o_orderkey, o.o_orderstatus""")
def range_join_listed(t):
    return joins.matched_since(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey", "l_shipdate", "o_orderdate", ["o_orderkey", "o_orderstatus"])


@query("""
WITH s AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error')
SELECT q.event_id, s.event_id AS previous, round(s.value, 4) AS value FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ts >= s.ts""")
def as_of_previous(t):
    events = t.events
    left = events.where("event_type = 'error'").select("user_id", "event_id", "ts")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("previous"), "ts", F.col("value").alias("price"))
    return joins.as_of(left, right, "user_id", "ts", ["previous", "price"]).select("event_id", "previous", F.round("price", 4).alias("value"))


_SNAPSHOT = """
SELECT o_custkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE {}) WHERE r = 1"""


def _snapshot(t, where):
    rows = t.orders.where(where)
    latest = normalize.first_by(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return latest.select("o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"))


_OLD, _NEW = "o_orderdate < TIMESTAMP '1998-01-01'", "o_orderdate >= TIMESTAMP '1995-01-01'"


@query(f"""
WITH b AS ({_SNAPSHOT.format(_OLD)}), a AS ({_SNAPSHOT.format(_NEW)}), u AS (SELECT *, 0 AS side FROM b UNION ALL SELECT *, 1 AS side FROM a)
SELECT o_custkey, o_orderstatus, o_orderpriority, day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC NULLS LAST, side DESC) AS r FROM u) WHERE r = 1""")
def merge_latest(t):
    return merge.latest_wins(_snapshot(t, _OLD), _snapshot(t, _NEW), "o_custkey", "day")


@query(f"""
WITH b AS ({_SNAPSHOT.format(_OLD)}), a AS ({_SNAPSHOT.format(_NEW)}),
j AS (SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS type,
  b.o_orderstatus AS s0, a.o_orderstatus AS s1, b.o_orderpriority AS p0, a.o_orderpriority AS p1 FROM b FULL JOIN a ON b.o_custkey = a.o_custkey)
SELECT o_custkey, type, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS "from", CAST(NULL AS VARCHAR) AS "to" FROM j WHERE type <> 'changed'
UNION ALL SELECT o_custkey, type, 'o_orderstatus', s0, s1 FROM j WHERE type = 'changed' AND s0 IS DISTINCT FROM s1
UNION ALL SELECT o_custkey, type, 'o_orderpriority', p0, p1 FROM j WHERE type = 'changed' AND p0 IS DISTINCT FROM p1""")
def snapshot_diff(t):
    return merge.snapshot_diff(_snapshot(t, _OLD), _snapshot(t, _NEW), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query(f"""
WITH h AS ({_SNAPSHOT.format(_OLD)}), t AS ({_SNAPSHOT.format(_NEW)})
SELECT coalesce(t.o_custkey, h.o_custkey) AS o_custkey, CASE WHEN t.o_custkey IS NOT NULL THEN t.o_orderstatus ELSE h.o_orderstatus END AS o_orderstatus, coalesce(nullif(t.o_orderpriority, '5-LOW'), h.o_orderpriority) AS o_orderpriority,
  CASE WHEN t.o_custkey IS NOT NULL THEN t.day ELSE h.day END AS day, t.o_custkey IS NOT NULL AS fetched_today FROM t FULL JOIN h ON t.o_custkey = h.o_custkey""")
def rolling_full_outer(t):
    today = _snapshot(t, _NEW).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return merge.fill_by_precedence(today, _snapshot(t, _OLD), "o_custkey", ["o_orderpriority"])


@query(f"""
WITH a AS ({_SNAPSHOT.format(_NEW)}), b AS ({_SNAPSHOT.format(_OLD)}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)""")
def online_first(t):
    return merge.online_first(_snapshot(t, _NEW), _snapshot(t, _OLD), "o_custkey")


@query("""
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'purchase' THEN event_type END) AS bought, max(CASE WHEN event_type = 'signup' THEN props END) AS signup, min(value) AS low FROM events GROUP BY 1, 2)
SELECT user_id, max(day) AS day, arg_max(bought, day) FILTER (WHERE bought IS NOT NULL) AS bought, arg_max(signup, day) FILTER (WHERE signup IS NOT NULL) AS signup, round(min(low), 4) AS low FROM e GROUP BY user_id""")
def merge_fill_blank(t):
    kind = lambda k, c: F.max(F.when(F.col("event_type") == k, F.col(c)))
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(kind("purchase", "event_type").alias("bought"), kind("signup", "props").alias("signup"), F.min("value").alias("low"))
    return merge.fold_by_recency(daily, "user_id", "day", ["bought", "signup"], ["low"]).withColumn("low", F.round("low", 4))


@query("""
SELECT event_type, CAST(k AS INTEGER) AS k, count(*) AS n FROM (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1, 2""")
def props_extract(t):
    return t.events.select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""
SELECT event_type, count(*) AS calls, sum(CASE WHEN value < 1 THEN 1 ELSE 0 END)::BIGINT AS failures, CAST(floor(avg(value) + 0.5) AS BIGINT) AS avg_ms FROM events GROUP BY event_type""")
def usage_summary(t):
    return usage.by_group(t.events, ["event_type"], F.col("value") >= 1, "value")


@query("""
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total, CAST(grouping(CAST(ts AS DATE), event_type) AS BIGINT) AS level FROM events GROUP BY ROLLUP (CAST(ts AS DATE), event_type)""")
def usage_rollup(t):
    out = usage.rollup(t.events.select(F.to_date("ts").alias("day"), "event_type", "value"), ["day", "event_type"], "value")
    return out.select("day", "event_type", "n", F.round("total", 2).alias("total"), F.col("level").cast("long").alias("level"))


@query("""
SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def facet_counts(t):
    return usage.facets(t.documents, ["lang", "source"])


@query("""
WITH w AS (SELECT unnest(range(0, 6)) AS k), e AS (SELECT event_type, value, date_trunc('hour', ts) AS h FROM events)
SELECT h - INTERVAL 1 HOUR * k AS start, event_type, count(*) AS n FROM e, w GROUP BY 1, 2""")
def rolling_hours(t):
    out = t.events.groupBy(F.window("ts", "6 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


_QUERY_NAMES = "|".join(urls.TRACKING)


@query(f"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), '^www\\.', '') AS host,
  regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_full_match(lower(split_part(x, '=', 1)), '{_QUERY_NAMES}'))), '&'), ''), '') AS canonical,
  nullif(host, '') AS host FROM p""")
def canonical_url(t):
    return t.pages.select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.host(F.col("url")).alias("host"))


@query(r"""
WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, CAST(len(regexp_extract_all(html, '\sid="([^"]*)"', 1)) AS INTEGER) AS n_ids FROM b""")
def html_text(t):
    return t.pages.select("page_id", text.html_to_text(F.col("html")).alias("text"), F.size(text.element_ids(F.col("html"))).alias("n_ids"))


@query("""
SELECT page_id, CAST(list_reduce(list_transform(string_split(url, ''), lambda c: CAST(ord(c) AS HUGEINT)), lambda a, c: (a * 33 + c) % 4294967296, CAST(5381 AS HUGEINT)) AS BIGINT) AS hash FROM pages""")
def item_hash(t):
    return t.pages.select("page_id", text.djb2(F.col("url")).alias("hash"))


@query(r"""
SELECT conv_id, turn, CAST(length(text) - length(regexp_replace(text, '[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]', '', 'g')) + ceil(length(regexp_replace(text, '[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]', '', 'g')) / 4) AS BIGINT) AS tokens FROM conversations""")
def token_estimate(t):
    return t.conversations.select("conv_id", "turn", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""
SELECT conv_id, turn, CASE WHEN length(t) > 90 THEN substr(t, 1, 90) || '…' ELSE t END AS clipped, substr(regexp_replace(text, '\s+', '', 'g'), 1, 16) AS key,
  CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[.,;:!?\n，。；：！？、]+'), lambda c: trim(c)), lambda c: c <> '')) AS INTEGER) AS clauses
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)""")
def text_clips(t):
    c = F.col("text")
    return t.conversations.select("conv_id", "turn", text.clip(c).alias("clipped"), text.title_key(c).alias("key"), F.size(text.split_clauses(c)).alias("clauses"))
