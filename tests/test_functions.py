import datetime as dt
import re
from urllib.parse import parse_qsl, urlsplit

import pytest
from pyspark.sql import functions as F

from feedmill.functions import dates, lexicon, text, urls


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in frame.withColumn("x", expression(F.col("v"))).orderBy("i").collect()]


def grams(s):
    t = "".join(c for c in (s or "").lower() if c.isalnum())
    return {t} if len(t) == 1 else {t[i : i + 2] for i in range(len(t) - 1)}


TITLES = [None, "", "!!", "a", "A b", "Rates: cut!", "rates cut", "Énergie 40", "日本 银行"]


def test_title_bigrams(spark):
    assert [set(x) for x in column(spark, TITLES, text.title_bigrams)] == [grams(s) if s and grams(s) != {""} else set() for s in TITLES]


def test_similarities_differ_only_for_empty_sets(spark):
    pairs = [(a, b) for a in TITLES for b in TITLES]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    out = frame.select("i", text.title_similarity(a, b).alias("j"), text.title_similarity_dice(a, b).alias("d"), text.similarity(a, b).alias("s"), text.token_jaccard(a, b).alias("t")).orderBy("i").collect()
    for row, (x, y) in zip(out, pairs, strict=True):
        g, h = grams(x) - {""}, grams(y) - {""}
        both = len(g & h)
        assert row.j == pytest.approx(both / len(g | h) if g | h else 1)
        assert row.d == pytest.approx(2 * both / (len(g) + len(h)) if g or h else 1)
        assert row.s == pytest.approx(2 * both / (len(g) + len(h)) if g or h else 0)
        assert row.t == pytest.approx(row.t) and 0 <= row.t <= 1


def test_texts(spark):
    assert column(spark, [None, " a \n b ", "x" * 91], text.clip) == ["", "a b", "x" * 90 + "…"]
    assert column(spark, ["short", "Ab " * 40, "Ab " * 41], text.content_fingerprint) == ["", "", "ab" * 41]
    assert column(spark, ["One. Bad one! Two."], lambda c: text.scrub_sentences(c, "(?i)bad")) == ["One. Two."]
    assert column(spark, ["<p>a&amp;b</p><script>x<y</script><!-- c --> d"], text.html_to_text) == ["a&b d"]
    assert column(spark, ["", "abcd", "abcde", "日本x"], text.estimate_tokens) == [0, 1, 2, 3]
    cases = ["```json\n{\"a\": 1}\n```", "no", "[1, 2] x", "{bad", '{"a":1} then {"b":2}', 'so: [{"a": "}]"}, {"b": "\\\\\\""}] end]', None, "", '{"a": [1}']
    assert column(spark, cases, text.first_json) == ['{"a": 1}', None, "[1, 2]", None, '{"a":1}', '[{"a": "}]"}, {"b": "\\\\\\""}]', None, None, None]
    assert column(spark, ["up 3.5 % in 40 years, 7"], text.numeric_anchors) == [["3.5%", "40years"]]
    assert column(spark, ["a, b; ;c."], text.split_clauses) == [["a", "b", "c"]]
    assert column(spark, [-1.5, 1.5, 2.4], text.round_half_up, "double") == [-1, 2, 2]
    assert column(spark, [900, 150_000, 3_000_000], text.format_tokens, "long") == ["600", "100.0K", "2.0M"]


def test_item_ids(spark):
    def djb2(s):
        h = 5381
        for c in s:
            h = (h * 33 + ord(c)) % 2**32
        digits = ""
        while h:
            digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
        return "itm-" + digits

    links = ["http://a/b?c=1", "x", "https://example.org/" + "p" * 200]
    assert column(spark, [None, "", *links], text.item_id) == ["itm-0", "itm-0", *map(djb2, links)]


LINKS = ["HTTPS://WWW.Example.com/a/?utm_source=x&b=2&a=1#sec", "http://x.org", "http://x.org/", "http://x.org/p?Ref=1", "no link", "", "https://a.b/c?z=1&y&a=%20", None]


def test_canonical_url(spark):
    def want(u):
        if not u or "://" not in u:
            return u
        s = urlsplit(u)
        host = s.netloc.lower().removeprefix("www.")
        path = s.path[:-1] if len(s.path) > 1 and s.path.endswith("/") else s.path or "/"
        keep = sorted((p for p in s.query.split("&") if p and p.split("=")[0].lower() not in urls.TRACKING), key=lambda p: p.split("=")[0])
        assert parse_qsl(s.query) is not None
        return f"{s.scheme.lower()}://{host}{path}" + ("?" + "&".join(keep) if keep else "")

    assert column(spark, LINKS, urls.canonical_url) == [want(u) for u in LINKS]


def test_date_from_url(spark):
    assert column(spark, ["http://a/2024/02/29/x", "http://a/20240230/2024-03-01", "http://a/123", None], urls.date_from_url) == [dt.date(2024, 2, 29), dt.date(2024, 3, 1), None, None]


def test_days(spark):
    times = ["2024-01-01 15:59:59", "2024-01-01 16:00:00", "2024-01-03 16:00:00", None]
    today = F.to_date(F.lit("2024-01-02"))
    assert column(spark, times, lambda c: dates.within_calendar_days(c.cast("timestamp"), today, 1)) == [False, True, False, False]
    assert column(spark, times, lambda c: dates.within_calendar_days(c.cast("timestamp"), today, 2)) == [True, True, False, False]
    assert column(spark, ["2024-01-01", "2023-12-31", "2024-01-03", None], lambda c: dates.within_gap(c.cast("date"), today, 1)) == [True, False, False, False]
    assert column(spark, ["2024-01-05", None], lambda c: dates.signed_gap(today, c.cast("date"))) == [3, 0] and column(spark, ["2024-01-01"], lambda c: dates.clamped_gap(today, c.cast("date"))) == [0]
    assert column(spark, ["2024-01-06", "2024-01-07", "2024-01-08", "2024-01-09"], lambda c: dates.is_weekend_edition(c.cast("date"))) == [True, True, True, False]
    assert column(spark, ["2024-01-07", "2024-01-08", "2024-01-09"], lambda c: dates.previous_trading_day(c.cast("date"))) == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(2024, 1, 8)]
    assert column(spark, ["2024-03-01"], lambda c: dates.recent_mmdd(c.cast("date"), 3)) == [["03/01", "02/29", "02/28"]]
    assert column(spark, ["2024-01-01 16:00:00", "2024-01-01 00:00:00", "2024-01-01 01:00:00", None], lambda c: dates.is_date_only(c.cast("timestamp"))) == [True, True, False, False]


def test_published_times(spark):
    values = ["2024-01-02 03:04:05", "2024-01-02T03:04", "2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+01:00", "bad", None]
    hours = [dt.datetime(2024, 1, 1, 19, 4, 5), dt.datetime(2024, 1, 1, 19, 4), dt.datetime(2024, 1, 1, 16), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 2, 4, 5), None, None]
    out = column(spark, values, lambda c: F.date_format(dates.normal_published(c), "yyyy-MM-dd HH:mm:ss"))
    assert out == [h and h.strftime("%Y-%m-%d %H:%M:%S") for h in hours]


def test_age_factor(spark):
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    ages = ["2024-01-09 00:00:00", "2024-01-08 12:00:00", "2024-01-01 00:00:00", "2024-02-01 00:00:00", None]
    assert column(spark, ages, lambda c: dates.age_factor(c.cast("timestamp"), now)) == [1.0, 0.9, 0.8, 1.0, 1.0]


def test_lexicon(spark):
    words = ["a.c", "plus+", "(", "two words"]
    for value in ("xabcx", "pluss", "(", "Two WORDS", "nothing"):
        assert column(spark, [value], lambda c: lexicon.hits(c, words)) == [bool(re.search(lexicon.alternation(words)[4:], value, re.I))]
    assert column(spark, [None, "x"], lambda c: lexicon.hits(c, [])) == [False, False]
    assert column(spark, ["red bolt", "bolt", "x"], lambda c: lexicon.first_match(c, {"colour": ["red"], "part": ["bolt"]}, "none")) == ["colour", "part", "none"]
    assert column(spark, ["red bolt"], lambda c: lexicon.all_matches(c, {"part": ["bolt"], "wood": ["oak"], "colour": ["red"]})) == [["part", "colour"]]
    assert column(spark, ["red bolt"], lambda c: lexicon.cue_sum(c, [(["red"], 80), (["bolt"], 30)])) == [100.0]
    assert column(spark, ["Red bolt"], lambda c: lexicon.contained(c, ["bolt", "oak", "red"])) == [["bolt", "red"]]


def test_listing_answers_with_stamps_nulls_and_junk(spark):
    from feedmill.sources import listings as services

    answers = ['[{"listInfo":{"content":[{"stockCode":"830001","companyName":"A","listDate":1705248000000,"registerAddress":"Shenzhen"},{"stockCode":"","companyName":"B","listDate":"2024-01-15"},{"stockCode":"830002","companyName":null,"stockName":"C","issueResultDate":"2024/01/16","registerAddress":"Shenzhen"}]}}]', None, "", "no json", "[]"]
    rows = services.listings(spark.createDataFrame([(a,) for a in answers], "answer string"), "answer", "BSE", F.lit("2024-01-10").cast("date")).collect()
    assert sorted((r.code, r.name, str(r.listed)) for r in rows) == [("830001", "A", "2024-01-15"), ("830002", "C", "2024-01-16")]


def test_candidates_without_a_company_stand_alone(spark):
    from feedmill.operators import listings as candidates

    rows = spark.createDataFrame([(1, None, "2024-01-02", "stage-listed", None), (2, " ", "2024-01-01", None, True), (3, "c", "2024-01-01", "stage-listed", False), (4, "c", "2024-01-02", "stage-listed", False)], "id int, company string, day string, stage string, raised boolean")
    best = candidates.candidates(rows, "stage", "raised", "company", "day", "id")
    assert sorted((r.id, r.score) for r in best.collect()) == [(1, 1), (2, 2), (4, 1)]
    assert [r.id for r in candidates.top(best, "day", "id").collect()] == [2, 1, 4]
    assert candidates.candidates(rows.limit(0), "stage", "raised", "company", "day", "id").count() == 0
