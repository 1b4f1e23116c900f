import datetime
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from feedmill.sources import listing

RULES = json.dumps([{"layout": "list", "within": "li", "url": "", "skip": "", "title_from": "", "words": "", "least": 1, "most": 100, "dates": r"(\d{4})-(\d\d)-(\d\d)", "date_tag": "span", "base": "", "prefix": "", "once": False, "limit": 1000}])


def page(days, source="s"):
    return "<ul>" + "".join(f'<li><a href="/{source}/{d}/{i}">title {i}</a><span>{d}</span></li>' for i, d in enumerate(days))


class Site:
    """A site on this machine that counts what is asked of it."""

    def __init__(self):
        self.pages, self.asked, self.wrong = {}, [], {}
        site = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                site.asked.append(self.path)
                code = site.wrong[self.path].pop(0) if site.wrong.get(self.path) else 200 if self.path in site.pages else 404
                self.send_response(code)
                self.end_headers()
                if code == 200:
                    self.wfile.write(site.pages[self.path].encode())

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def site(spark):
    listing.register(spark)
    out = Site()
    yield out
    out.server.shutdown()


def load(spark, site, **options):
    sources = json.dumps([{"id": s, "url": f"{site.base}/{s}/{{page}}", "layout": "list"} for s in ("s", "t")])
    return spark.read.format("listing").options(sources=sources, layouts=RULES, **{k: str(v) for k, v in options.items()}).load()


def days(first, n):
    return [str(datetime.date(2024, 6, 30) - datetime.timedelta(days=first + i)) for i in range(n)]


def test_a_floor_stops_the_paging(spark, site, capsys):
    for s in ("s", "t"):
        site.pages.update({f"/{s}/{p}": page(days(5 * (p - 1), 5), s) for p in range(1, 12)})
    frame = load(spark, site).where((F.col("day") >= F.lit("2024-06-20").cast("date")) & (F.col("position") < 4))
    frame.explain("formatted")
    assert "PushedFilters: [GreaterThanOrEqual(day,2024-06-20)]" in capsys.readouterr().out
    rows = frame.collect()
    assert sorted((r.source_id, str(r.day)) for r in rows) == sorted((s, d) for s in ("s", "t") for d in days(0, 11) if (datetime.date(2024, 6, 30) - datetime.date.fromisoformat(d)).days % 5 < 4)
    assert sorted(site.asked) == sorted(f"/{s}/{p}" for s in ("s", "t") for p in (1, 2, 3, 4))  # of 11 pages; the fourth is all older


def test_sources_are_chosen_before_anything_is_asked(spark, site):
    site.pages.update({"/s/1": page(days(0, 3)), "/t/1": page(days(0, 3))})
    assert load(spark, site).where("source_id = 's' and day > date'2024-06-28'").count() == 2
    assert {p.split("/")[1] for p in site.asked} == {"s"}
    assert load(spark, site).where("source_id in ('s', 'x') and source_id = 't'").count() == 0


def test_without_a_floor_pages_end_where_they_end(spark, site):
    site.pages.update({f"/s/{p}": page(days(0, 2)) for p in range(1, 6)} | {"/t/1": page(days(0, 1)), "/t/2": "<p>nothing", "/t/3": page(days(0, 1))})
    assert {r.source_id: r["count"] for r in load(spark, site).groupBy("source_id").count().collect()} == {"s": 10, "t": 1}
    assert load(spark, site, max_pages=3).where("source_id = 's'").count() == 6


def test_pages_without_days_end_a_search_for_a_floor(spark, site):
    site.pages.update({f"/s/{p}": '<li><a href="/x">no day</a></li>' for p in range(1, 9)})
    assert load(spark, site, stale_pages=2).where("source_id = 's' and day >= date'2024-01-01'").count() == 0
    assert len(site.asked) == 2
    assert load(spark, site).where("source_id = 's'").count() == 8


def test_mixed_pages_do_not_end_the_paging(spark, site):
    site.pages.update({"/s/1": page(["2024-06-30", "2023-01-01"]), "/s/2": page(["2022-01-01", "2024-06-29"]), "/s/3": page(["2022-01-01"]), "/s/4": page(["2024-06-30"])})
    assert load(spark, site).where("source_id = 's' and day >= date'2024-06-01'").count() == 2


def test_passing_errors_are_tried_again_and_others_fail(spark, site):
    site.pages["/s/1"], site.wrong["/s/1"] = page(days(0, 2)), [503]
    assert load(spark, site).where("source_id = 's'").count() == 2
    site.wrong["/s/2"] = [500] * 50
    with pytest.raises(Exception, match="500"):
        load(spark, site).where("source_id = 's'").count()


def stream(spark, site, out, pages=2):
    sources = json.dumps([{"id": s, "url": f"{site.base}/{s}/{{page}}", "layout": "list"} for s in ("s", "t")])
    rows = spark.readStream.format("listing").options(sources=sources, layouts=RULES, max_pages=str(pages), checkpoint=f"file://{out}/state").load()
    query = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


def counted(spark, out):
    return {(r.source_id, r.page): r["count"] for r in spark.read.parquet(f"{out}/rows").groupBy("source_id", "page").count().collect()}


def test_a_restarted_stream_neither_repeats_nor_loses_a_page(spark, site, tmp_path):
    site.pages.update({f"/s/{p}": page(days(p, 3)) for p in range(1, 6)} | {f"/t/{p}": page(days(p, 2)) for p in range(1, 3)})
    batches = stream(spark, site, tmp_path)
    assert batches == [10, 6, 3]  # two pages of a source at most
    assert counted(spark, tmp_path) == {("s", p): 3 for p in range(1, 6)} | {("t", p): 2 for p in range(1, 3)}
    site.pages.update({f"/s/{p}": page(days(p, 3)) for p in range(6, 9)} | {"/t/3": page(days(3, 2))})
    before = len(site.asked)
    assert stream(spark, site, tmp_path) == [8, 3]
    assert not [p for p in site.asked[before:] if p in ("/s/1", "/s/5", "/t/1")]  # old pages aren't even asked for
    assert counted(spark, tmp_path) == {("s", p): 3 for p in range(1, 9)} | {("t", p): 2 for p in range(1, 4)}


def test_a_failing_page_is_read_when_it_is_back(spark, site, tmp_path):
    site.pages.update({f"/s/{p}": page(days(p, 3)) for p in range(1, 4)})
    site.wrong["/s/2"] = [200] + [500] * 40  # it answers when it is looked for, and fails when it is read
    with pytest.raises(Exception, match="500"):
        stream(spark, site, tmp_path)
    site.wrong.clear()
    stream(spark, site, tmp_path)
    assert counted(spark, tmp_path) == {("s", p): 3 for p in range(1, 4)}


def test_a_stream_needs_its_checkpoint(spark, site):
    with pytest.raises(Exception, match="checkpoint"):
        spark.readStream.format("listing").options(sources="[]").load().writeStream.format("noop").start().processAllAvailable()
