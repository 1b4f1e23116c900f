"""Event identity, event memory, broadcasts and issues over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedmill.functions import events, text
from feedmill.functions.vocabulary import Events
from feedmill.operators import broadcasts, identity, memory
from feedmill.plans.registry import query

#: Anchors that the tables' names of parts hold; colours and such say nothing of what a part is.
PARTS = Events(
    anchors=("bolt", "ring", "widget", "plate", "rod", "Brand#1", "Brand#2", "PROMO", "red", "blue", "hot", "old", "small"), generic=("red", "blue", "hot", "old", "small"), synonyms=(("bolt|nut", "bolt"),),
    stages=("PROMO", "ECONOMY"), bodies=("Brand#1", "Brand#2", "red"), places=("red",), themes={"fasteners": ("bolt", "nut"), "flat": ("plate", "ring"), "colour": ("red", "blue")},
    anchor_units="years|percent", fact_units="years|percent", short_units={"percent": "pct"}, period=r"^#\d+years$",
)

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_FP = f"list_distinct(list_concat(list_filter({_LIST(PARTS.anchors)}, lambda w: contains({{0}}, w)), list_transform(regexp_extract_all({{0}}, '(\\d+(?:\\.\\d+)?\\s*(?:years|percent))', 1), lambda x: '#' || regexp_replace(x, '\\s+', '', 'g'))))"
_SUBJECTS = f"list_filter({{0}}, lambda a: NOT starts_with(a, '#') AND NOT list_contains({_LIST(PARTS.generic)}, a))"
_FACTS = f"""list_distinct(list_concat(list_concat(list_transform(regexp_extract_all({{0}}, '(\\d+(?:\\.\\d+)?\\s*(?:years|percent))', 1), lambda x: '#' || replace(regexp_replace(x, '\\s+', '', 'g'), 'percent', 'pct')),
  list_transform(list_filter({_LIST(PARTS.stages)}, lambda w: contains({{0}}, w)), lambda w: '!' || w)), list_transform(list_filter({_LIST(PARTS.bodies)}, lambda w: contains({{0}}, w)), lambda w: '@' || w)))"""
_THEMES = "list_filter([" + ", ".join(f"CASE WHEN len(list_filter({_LIST(w)}, lambda w: contains({{0}}, w))) > 0 THEN '{n}' END" for n, w in PARTS.themes.items()) + "], lambda x: x IS NOT NULL)"
_TITLES = """t AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || (p_size % 7) || ' years' AS title, p_type || ' ' || p_name || ' ' || (p_size % 3) || ' percent' AS body FROM part)"""
_ONE = "regexp_replace({0}, 'bolt|nut', 'bolt', 'g')"
_SAME = f"(len(list_intersect({{0}}, {{1}})) >= 2 AND len({_SUBJECTS.format('list_intersect({0}, {1})')}) >= 1)"


def _titles(t, *more):
    title = F.concat_ws(" ", "p_name", "p_brand", (F.col("p_size") % 7).cast("string"), F.lit("years"))
    return t.part.select(F.col("p_partkey").alias("id"), title.alias("title"), F.concat_ws(" ", "p_type", "p_name", (F.col("p_size") % 3).cast("string"), F.lit("percent")).alias("body"), *more)


@query(f"""
WITH {_TITLES}, f AS (SELECT id, {_FP.format(_ONE.format('title'))} AS fp FROM t) SELECT id, array_to_string(list_sort(fp), ',') AS anchors, array_to_string(list_sort({_SUBJECTS.format('fp')}), ',') AS subjects FROM f""")
def event_fingerprint(t):
    fp = events.fingerprint(F.col("title"), PARTS)
    return _titles(t).select("id", F.array_join(F.array_sort(fp), ",").alias("anchors"), F.array_join(F.array_sort(events.subjects(fp, PARTS)), ",").alias("subjects"))


@query(f"""
WITH {_TITLES}, f AS (SELECT id, {_FP.format(_ONE.format('title'))} AS a, {_THEMES.format('title')} AS g FROM t), p AS (SELECT *, lag(a) OVER (ORDER BY id) AS b, lag(g) OVER (ORDER BY id) AS h FROM f)
SELECT id, {_SAME.format('a', 'b')} AS same, CAST(len(list_intersect({_SUBJECTS.format('a')}, {_SUBJECTS.format('b')})) AS BIGINT) AS subjects, CAST(len(list_intersect(g, h)) AS BIGINT) AS tags,
  round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard,
  round(CASE WHEN len(a) < 2 OR len(b) < 2 OR len(list_intersect(a, b)) < 2 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS coverage FROM p WHERE b IS NOT NULL""")
def same_event(t):
    rows = _titles(t)
    before = rows.select((F.col("id") + 1).alias("id"), F.col("title").alias("before"))  # ids have no gaps
    both = rows.join(before, "id")
    a, b = events.fingerprint(F.col("title"), PARTS), events.fingerprint(F.col("before"), PARTS)
    tags = events.shared_tags(events.themes(F.col("title"), PARTS), events.themes(F.col("before"), PARTS))
    return both.select(
        "id", events.same_event(F.col("title"), F.col("before"), PARTS).alias("same"), events.shared_subjects(a, b, PARTS).cast("long").alias("subjects"), tags.cast("long").alias("tags"),
        F.round(events.anchor_jaccard(a, b), 6).alias("jaccard"), F.round(events.candidate_coverage(a, b), 6).alias("coverage"),
    )


@query(f"""
WITH {_TITLES}, f AS (SELECT id, list_distinct(list_concat({_FP.format(_ONE.format('title'))}, list_filter({_FP.format(_ONE.format('body'))}, lambda a: a <> 'red'))) AS a, list_distinct(list_concat({_FACTS.format('title')}, list_filter({_FACTS.format('body')}, lambda a: a <> '@red'))) AS f, {_THEMES.format("title || ' ' || body")} AS g FROM t)
SELECT id, array_to_string(list_sort(a), ',') AS anchors, array_to_string(list_sort(f), ',') AS facts, array_to_string(g, ',') AS tags,
  array_to_string(list_concat(list_sort(list_filter(a, lambda x: starts_with(x, '#')))[1:2], list_sort(list_filter(a, lambda x: NOT starts_with(x, '#')))[1:3]), '|') AS event_id FROM f""")
def candidate_facts(t):
    anchors = events.candidate_anchors(F.col("title"), F.col("body"), PARTS)
    found = events.candidate_facts(F.col("title"), F.col("body"), PARTS)
    return _titles(t).select("id", F.array_join(F.array_sort(anchors), ",").alias("anchors"), F.array_join(F.array_sort(found), ",").alias("facts"), F.array_join(events.themes(F.concat_ws(" ", "title", "body"), PARTS), ",").alias("tags"), events.event_id(anchors).alias("event_id"))


_GRAMS = r"list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr({0}, i, 2)))".format(r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))")
_DICE = "2 * len(list_intersect({0}, {1})) / (len({0}) + len({1}))"


@query(f"""
WITH {_TITLES}, f AS (SELECT id, list_distinct(list_concat({_FACTS.format('title')}, list_filter({_FACTS.format('body')}, lambda a: a <> '@red'))) AS f, {_GRAMS.format("(title || ' ' || body)")} AS g, {_GRAMS.format('title')} AS d FROM t),
p AS (SELECT a.id, a.f AS nf, b.f AS old, a.g AS ng, b.g AS og, {_DICE.format('a.d', 'b.d')} AS told FROM f a JOIN f b ON a.id = b.id + 1),
n AS (SELECT *, list_filter(nf, lambda x: NOT list_contains(old, x)) AS fresh FROM p),
r AS (SELECT id, told, fresh, 0.45::DOUBLE * CASE WHEN len(nf) = 0 THEN 0 ELSE least(len(fresh) / greatest(len(nf), len(old), 1), CASE WHEN len(old) = 0 THEN 0.5 ELSE 1 END) END + 0.35::DOUBLE * len(list_filter(ng, lambda x: NOT list_contains(og, x))) / len(ng)
  + CASE WHEN len(list_filter(fresh, lambda x: starts_with(x, '!'))) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(fresh, lambda x: regexp_matches(x, '^#\\d+years$'))) > 0 THEN 0.2::DOUBLE ELSE 0 END AS raw FROM n),
v AS (SELECT id, len(fresh) AS k, greatest(0, least(1, raw * (1 - CASE WHEN told > 0.6 THEN least((told - 0.6::DOUBLE) / 0.4::DOUBLE, 1) * 0.45::DOUBLE ELSE 0 END))) AS novel FROM r)
SELECT id, round(novel, 6) AS novelty, novel >= 0.25 AND (id % 11 = 0 OR (id % 2 = 0 AND id % 100 >= 80) OR (id % 3 = 0 AND k > 0)) AS breaks FROM v""")
def event_novelty(t):
    rows = _titles(t)
    old = rows.select((F.col("id") + 1).alias("id"), F.col("title").alias("old_title"), F.col("body").alias("old_body"))
    both = rows.join(old.hint("merge"), "id")  # texts are joined and their sets made after it; by the file's size Spark would broadcast them
    for at in ("", "old_"):
        title, body = F.col(f"{at}title"), F.col(f"{at}body")
        both = both.withColumns({f"{at}facts": events.candidate_facts(title, body, PARTS), f"{at}grams": text.title_bigrams(F.concat_ws(" ", title, body))})
    both = both.withColumn("novel", events.novelty(F.col("facts"), F.col("old_facts"), F.col("grams"), F.col("old_grams"), events.title_dice(F.col("title"), F.col("old_title")), PARTS))
    tier, section = F.when(F.col("id") % 2 == 0, "must_read"), F.when(F.col("id") % 3 == 0, "risk").otherwise("other")
    breaks = events.can_break_cooldown(F.col("novel"), F.col("id") % 11 == 0, tier, F.col("id") % 100, section, F.size(F.array_except("facts", "old_facts")))
    novelty = F.round(F.col("novel") * 1e6) / 1e6  # in binary, as SQL rounds: by its decimal digits 0.5103125 would go up
    return both.select("id", novelty.alias("novelty"), breaks.alias("breaks"))


_GREEDY = f"""
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS i, pos, url, fp FROM r),
m AS MATERIALIZED (SELECT b.i, list(a.i) AS earlier FROM s a JOIN s b ON a.i < b.i WHERE (a.url <> '' AND a.url = b.url) OR {_SAME.format('a.fp', 'b.fp')} GROUP BY b.i),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT g.i + 1, CASE WHEN len(list_intersect(coalesce(m.earlier, []), g.kept)) > 0 THEN g.kept ELSE list_append(g.kept, g.i + 1) END FROM g LEFT JOIN m ON m.i = g.i + 1 WHERE g.i < (SELECT max(i) FROM s))
SELECT s.pos FROM s, (SELECT kept FROM g WHERE i = (SELECT max(i) FROM s)) WHERE list_contains(kept, s.i)"""


@query(f"""
WITH RECURSIVE t AS (SELECT p_partkey AS id, p_name || ' ' || (p_size % 3) || ' years' AS title FROM part), r AS (SELECT min(id) AS pos, '' AS url, fp FROM (SELECT id, list_sort({_FP.format(_ONE.format('title'))}) AS fp FROM t) WHERE {_SAME.format('fp', 'fp')} GROUP BY fp), {_GREEDY}""")
def dedupe_sections(t):
    rows = t.part.select(F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", F.col("p_size") % 3, F.lit("years")).alias("title"), F.lit(None).cast("string").alias("url"))
    own = F.array_sort(events.fingerprint(F.col("title"), PARTS))
    return identity.dedupe_sections(rows.where(events.same_event_anchors(own, own, PARTS)), PARTS).select("pos")


@query(f"""
WITH RECURSIVE r AS (SELECT s_suppkey AS pos, CASE WHEN s_nationkey % 3 = 0 THEN 'n' || s_nationkey ELSE '' END AS url, list_sort({_FP.format("('Brand#' || (s_suppkey % 3) || ' ring ' || s_nationkey || ' years')")}) AS fp FROM supplier), {_GREEDY}""")
def dedupe_sections_by_link(t):
    title = F.concat(F.lit("Brand#"), F.col("s_suppkey") % 3, F.lit(" ring "), F.col("s_nationkey"), F.lit(" years"))
    rows = t.supplier.select(F.col("s_suppkey").alias("pos"), title.alias("title"), F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("n"), F.col("s_nationkey"))).alias("url"))
    return identity.dedupe_sections(rows, PARTS).select("pos")


@query(f"""
WITH {_TITLES}, f AS (SELECT id, title, {_FP.format(_ONE.format('title'))} AS fp FROM t), seeds AS (SELECT DISTINCT list_sort(fp) AS fp FROM f JOIN part ON id = p_partkey WHERE p_size = 50 AND p_type = 'PROMO')
SELECT id AS pos, title FROM f WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE {_SAME.format('f.fp', 'seeds.fp')})""")
def not_told_in_sections(t):
    rows = _titles(t).select(F.col("id").alias("pos"), "title")
    seeds = t.part.where("p_size = 50 and p_type = 'PROMO'").select(F.col("p_partkey").alias("pos"))
    return identity.not_told_in(rows, rows.join(seeds, "pos"), PARTS)


_RECORDS = f"""r AS (SELECT 'e' || n AS event_id, title, url, fp, g FROM (SELECT p_size AS n, min_by(title, id) AS title, min_by(url, id) AS url, min_by(fp, id) AS fp, min_by(g, id) AS g FROM c JOIN part ON id = p_partkey GROUP BY p_size))"""


@query(f"""
WITH {_TITLES}, c AS (SELECT id, title, 'u' || (id % 97) AS url, {_FP.format(_ONE.format('title'))} AS fp, {_THEMES.format('title')} AS g, {_GRAMS.format('title')} AS d FROM t), {_RECORDS},
j AS (SELECT c.id, r.event_id, c.url = r.url AS same, CASE WHEN len(c.fp) = 0 OR len(r.fp) = 0 THEN 0 ELSE len(list_intersect(c.fp, r.fp)) / (len(c.fp) + len(r.fp) - len(list_intersect(c.fp, r.fp))) END AS aj, {_DICE.format('c.d', _GRAMS.format('r.title'))} AS td,
  CASE WHEN len(c.fp) < 2 OR len(r.fp) < 2 OR len(list_intersect(c.fp, r.fp)) < 2 THEN 0 ELSE len(list_intersect(c.fp, r.fp)) / len(c.fp) END AS cov, len({_SUBJECTS.format('list_intersect(c.fp, r.fp)')}) AS sj, len(list_intersect(c.g, r.g)) AS st FROM c, r),
h AS (SELECT *, greatest(aj, td, CASE WHEN aj >= 0.3 THEN cov ELSE 0 END) AS hard FROM j),
s AS (SELECT id, event_id, CASE WHEN same THEN 1.0 WHEN hard >= 0.5 THEN greatest(hard, 0.51) WHEN hard >= 0.3 AND ((sj >= 1 AND st >= 1) OR st >= 2) THEN 0.5 ELSE greatest(hard, CASE WHEN st >= 2 THEN 0.35 ELSE 0 END) END AS similarity FROM h)
SELECT id, event_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, event_id) = 1""")
def find_matching_event(t):
    rows = _titles(t, "p_size").withColumn("url", F.concat(F.lit("u"), F.col("id") % 97))
    first = rows.groupBy("p_size").agg(F.min_by(F.struct("title", "url"), "id").alias("x")).select(F.concat(F.lit("e"), F.col("p_size")).alias("event_id"), "x.*")
    made = lambda f: f.withColumns({"anchors": events.fingerprint(F.col("title"), PARTS), "tags": events.themes(F.col("title"), PARTS)})
    out = identity.best_match(made(rows.select("id", "title", "url")), made(first), PARTS)
    return out.select("id", "event_id", F.round("similarity", 6).alias("similarity"))


_SAMPLES = f"""
{_TITLES}, x AS (SELECT id, list_distinct(list_concat({_FP.format(_ONE.format('title'))}, list_filter({_FP.format(_ONE.format('body'))}, lambda a: a <> 'red'))) AS a, {_THEMES.format('title')} AS g, list_distinct(list_concat({_FACTS.format('title')}, list_filter({_FACTS.format('body')}, lambda a: a <> '@red'))) AS f, DATE '2024-01-01' + CAST(id % 9 AS INTEGER) AS day, CASE WHEN id % 4 = 0 THEN 'risk' ELSE 'news' END AS section, id % 90 AS score FROM t),
y AS (SELECT *, array_to_string(list_concat(list_sort(list_filter(a, lambda x: starts_with(x, '#')))[1:2], list_sort(list_filter(a, lambda x: NOT starts_with(x, '#')))[1:3]), '|') AS event_id FROM x)"""


def _samples(t):
    day, anchors = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int")), events.candidate_anchors(F.col("title"), F.col("body"), PARTS)
    rows = _titles(t).select("id", anchors.alias("anchors"), events.themes(F.col("title"), PARTS).alias("tags"), events.candidate_facts(F.col("title"), F.col("body"), PARTS).alias("facts"), day.alias("day"), F.when(F.col("id") % 4 == 0, "risk").otherwise("news").alias("section"), (F.col("id") % 90).alias("score"))
    return rows.withColumn("event_id", events.event_id(F.col("anchors")))


@query(f"""
WITH {_SAMPLES} SELECT event_id, array_to_string(list_sort(list_distinct(flatten(list(a)))), ',') AS anchors, array_to_string(list_sort(list_distinct(flatten(list(g)))), ',') AS tags, array_to_string(list_sort(list_distinct(flatten(list(f)))), ',') AS facts,
  min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days, array_to_string(list_sort(list_distinct(list(section))), ',') AS sections, max(score) AS peak_score FROM y GROUP BY event_id""")
def upsert_events(t):
    out = identity.upsert_events(_samples(t))
    return out.select("event_id", *(F.array_join(c, ",").alias(c) for c in ("anchors", "tags", "facts", "sections")), "first_day", "last_day", "days", "peak_score")


@query(f"""
WITH {_SAMPLES}, s AS (SELECT id, day, CASE WHEN id % 9 < 7 THEN 'run' || (id % 9 % 2) END AS run_id FROM y), d AS (SELECT DATE '2024-01-01' + k AS day, CASE WHEN k % 3 = 0 THEN NULL ELSE 'run' || (k % 2) END AS run_id FROM (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS k))
SELECT s.day, count(*) AS n FROM s JOIN d ON s.day = d.day WHERE s.day < DATE '2024-01-08' AND (s.run_id IS NULL OR d.run_id IS NULL OR s.run_id = d.run_id) GROUP BY s.day""")
def begin_day(t):
    staged = _samples(t).select("day", F.when(F.col("id") % 9 < 7, F.concat(F.lit("run"), F.col("id") % 9 % 2)).alias("run_id"))
    days = t.region.sparkSession.range(6).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("run"), F.col("id") % 2)).alias("run_id"))
    return identity.begin_day(staged, days, F.lit("2024-01-08").cast("date")).groupBy("day").agg(F.count("*").alias("n"))


_AT = "(CASE WHEN event_type <> 'error' THEN ts END)"


def _told(t):
    return t.events.withColumn("at", F.when(F.col("event_type") != "error", F.col("ts")))


@query(f"""
SELECT CASE WHEN {_AT} IS NULL THEN 'unknown' WHEN hour({_AT} + INTERVAL 8 HOUR) < 9 THEN 'before' ELSE 'after' END AS part, count(DISTINCT user_id) AS events, count(*) AS samples FROM events GROUP BY 1""")
def hours_summary(t):
    return broadcasts.summary(_told(t), "user_id", "at")


@query(f"""
SELECT event_id, strftime({_AT} + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS told, hour({_AT} + INTERVAL 8 HOUR) AS hour, coalesce({_AT} BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00', false) AS within FROM events""")
def broadcast_times(t):
    low, high = (F.to_timestamp_ntz(F.lit(x)) for x in ("2024-01-05 00:00:00", "2024-01-20 12:00:00"))
    out = broadcasts.listed(_told(t), "at")
    return out.select("event_id", broadcasts.format_at(F.col("at")).alias("told"), F.col("hour").cast("long").alias("hour"), broadcasts.in_range(F.col("at"), low, high).alias("within"))


@query(f"""
SELECT event_type, count(*) AS n FROM events WHERE {_AT} IS NULL OR NOT ({_AT} BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00') GROUP BY event_type""")
def prune_by_range(t):
    low, high = (F.to_timestamp_ntz(F.lit(x)) for x in ("2024-01-05 00:00:00", "2024-01-20 12:00:00"))
    return broadcasts.outside(_told(t), "at", low, high).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS date, min(event_type) AS source FROM events GROUP BY 1), n AS (SELECT date, 'schedule' AS source FROM d WHERE day(date) % 3 = 0),
s AS (SELECT * FROM d WHERE date NOT IN (SELECT date FROM n) UNION ALL SELECT * FROM n), l AS (SELECT DISTINCT date FROM s ORDER BY date DESC LIMIT 10)
SELECT date, source, source IN ('schedule', 'manual-final') AS final FROM s WHERE date IN (SELECT date FROM l)""")
def publish_state(t):
    state = t.events.groupBy(F.to_date("ts").alias("date")).agg(F.min("event_type").alias("source"))
    entry = state.where(F.dayofmonth("date") % 3 == 0).withColumn("source", F.lit("schedule"))
    out = broadcasts.latest_issues(broadcasts.record_publish(state, entry), 10)
    return out.select("date", "source", broadcasts.is_published(F.col("source")).alias("final"))


@query("""
WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS top FROM events GROUP BY 1, 2), p AS (SELECT *, lag(day) OVER w AS before, lag(top) OVER w AS old FROM u WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, CASE WHEN before IS NULL THEN 'new' WHEN (top - old) / top >= 0.35 OR day(day) % 7 = 0 THEN 'changed' ELSE 'followup' END AS delta FROM p""")
def deltas(t):
    w = Window.partitionBy("user_id").orderBy("day")
    rows = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("top")).withColumn("before", F.lag("day").over(w)).withColumn("old", F.lag("top").over(w))
    return rows.select("user_id", "day", memory.delta(F.col("before"), memory.ratio(F.col("top") - F.col("old"), F.col("top")), F.dayofmonth("day") % 7 == 0).alias("delta"))


@query("""
WITH e AS (SELECT user_id, max(CAST(ts AS DATE)) AS last, max(value) AS peak FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-28' GROUP BY user_id)
SELECT user_id, last FROM e WHERE date_diff('day', last, DATE '2024-02-06') <= CASE WHEN peak >= 60 THEN 12 ELSE 10 END ORDER BY last DESC, user_id LIMIT 400""")
def prune_memory(t):
    rows = t.events.where("to_date(ts) < date'2024-01-28'").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("last"), F.max("value").alias("peak"))
    return memory.prune(rows, F.lit("2024-02-06").cast("date"), "last", "peak", "user_id", 10, 12).select("user_id", "last")


@query("""
WITH u AS (SELECT user_id, list(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, len(list_filter(days, lambda d: date_diff('day', d, DATE '2024-01-30') BETWEEN 0 AND 6)) >= 2 AS often FROM u""")
def shown_often(t):
    days = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.collect_set(F.to_date("ts")).alias("days"))  # days of a user
    return days.select("user_id", memory.shown_often(F.col("days"), F.lit("2024-01-30").cast("date")).alias("often"))


@query("""
WITH s AS (SELECT CAST(ts AS DATE) AS day, max(event_id) % 5 AS sha FROM events GROUP BY 1), d AS (SELECT day, CASE WHEN day(day) % 4 = 0 THEN 9 ELSE sha END AS sha FROM s WHERE day(day) % 5 <> 0)
SELECT s.day, CASE WHEN d.sha IS NULL THEN 'no-delivery' WHEN d.sha = s.sha THEN 'delivered' ELSE 'mismatch' END AS status FROM s LEFT JOIN d ON s.day = d.day""")
def settlement_gate(t):
    staged = t.events.groupBy(F.to_date("ts").alias("day")).agg((F.max("event_id") % 5).alias("sha"))
    sent = staged.where(F.dayofmonth("day") % 5 != 0).withColumn("sha", F.when(F.dayofmonth("day") % 4 == 0, 9).otherwise(F.col("sha")))
    return memory.settle(staged, sent).select("day", "status")


@query("""
SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) > DATE '1999-01-10' THEN date_diff('day', CAST(o_orderdate - INTERVAL 200 DAY + INTERVAL 8 HOUR AS DATE), DATE '1999-01-10') BETWEEN 0 AND 1 ELSE date_diff('day', CAST(o_orderdate + INTERVAL 8 HOUR AS DATE), DATE '1999-01-10') BETWEEN 0 AND 1 END AS fresh FROM orders""")
def fresh_entries(t):
    return t.orders.select("o_orderkey", memory.is_fresh(F.col("o_orderdate"), F.expr("o_orderdate - interval 200 days"), F.lit("1999-01-10").cast("date")).alias("fresh"))
