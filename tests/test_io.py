import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from feedmill.sources import feeds, readers, sinks
from feedmill.streaming import folds


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "x", "n": 1}]))
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"title": "y"}]}))
    (tmp_path / "c.json").write_text("no json")
    assert {(r.title, r.n) for r in readers.json_documents(spark, str(tmp_path), "title string, n int").collect()} == {("x", 1), ("y", None)}
    (tmp_path / "map").mkdir()
    (tmp_path / "map/m.json").write_text(json.dumps({"u1": {"title": "a"}, "u2": {"title": "b"}}))
    assert {(r.url, r.title) for r in readers.keyed_map(spark, str(tmp_path / "map"), "title string").collect()} == {("u1", "a"), ("u2", "b")}


def test_line_readers(spark, tmp_path):
    (tmp_path / "calls-2024-01-01.jsonl").write_text('{"backend": "a"}\nbad\n')
    (tmp_path / "calls-2024-01-02.jsonl").write_text('{"backend": "b"}\n')
    assert readers.json_lines(spark, str(tmp_path), "backend string").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path), "backend string", strict=True).collect()
    assert [r.backend for r in readers.dated_lines(spark, str(tmp_path), "backend string", since="2024-01-02").collect()] == ["b"]
    with pytest.raises(ValueError, match="no JSON"):
        readers.ledger(spark, str(tmp_path / "calls-2024-01-01.jsonl"), "backend string")
    assert readers.ledger(spark, str(tmp_path / "none"), "backend string").count() == 0


def test_csv_and_rss(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,n\r\n1,"a ""quoted"", b",5\r\n,blank,1\r\n2,"two\nlines",x\r\n')
    out = readers.csv_rows(spark, str(tmp_path / "a.csv"), {"id": "string", "name": "string", "n": "int"}, "id").collect()
    assert {(r.id, r.name, r.n) for r in out} == {("1", 'a "quoted", b', 5), ("2", "two\nlines", 0)}
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> T </title><link>http://a</link><description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0800</pubDate></item><item><title>U</title><link>http://b</link></item></channel></rss>")
    out = {r.title: (r.url, str(r.published_at)) for r in readers.rss(spark, str(tmp_path / "f.xml"), "s").collect()}
    assert out == {"T": ("http://a", "2024-01-01 02:00:00"), "U": ("http://b", "None")}


def test_responses_and_pages(spark):
    rows = spark.createDataFrame([("a", 'cb({"items": [{"title": "x"}, {"title": "y"}]});'), ("b", '[{"title": "z"}]'), ("c", "bad"), ("d", '{"data": [{"title": "w"}]}')], "s string, body string")
    assert {(r.s, r.title) for r in readers.api_items(rows, "body", "title string", most=1).collect()} == {("a", "x"), ("b", "z"), ("d", "w")}
    pages = spark.createDataFrame([(1, '<a href="/x">A long  <b>title</b></a><a href="/y">tiny</a>'), (2, None)], "id int, html string")
    assert [(r.id, r.url, r.title) for r in readers.anchors(pages, "html").collect()] == [(1, "/x", "A long title")]
    tables = spark.createDataFrame([(1, "<table><tr><td>a</td><td><b>b</b></td></tr><tr><td>x</td></tr></table>")], "id int, html string")
    assert [r.cells for r in readers.table_rows(tables, "html", 2).collect()] == [["a", "b"]]


def test_feed_source_isolates_failures(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>http://a</link></item></channel></rss>")
    (tmp_path / "f.json").write_text(json.dumps({"data": [{"title": "J", "url": "http://j"}]}))
    feeds.register(spark)
    sources = [{"id": "x", "url": f"file://{tmp_path}/f.xml", "type": "rss"}, {"id": "j", "url": f"file://{tmp_path}/f.json", "type": "api"}, {"id": "bad", "url": f"file://{tmp_path}/none", "type": "rss"}, {"id": "off", "url": "x", "enabled": False}]
    out = spark.read.format("feeds").option("sources", json.dumps(sources)).load().collect()
    assert {(r.source_id, r.status, r.title) for r in out} == {("x", "ok", "T"), ("j", "ok", "J"), ("bad", "failed", None)}
    tried = []
    with pytest.raises(OSError):
        feeds.fetched("x", tries=2, fetch=lambda u: tried.append(u) or (_ for _ in ()).throw(OSError("down")))
    assert len(tried) == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "n int, date string")
    path = str(tmp_path / "snap")
    sinks.dated_snapshot(rows, path)
    sinks.dated_snapshot(rows.where("n = 2").withColumn("n", F.lit(9)), path)
    assert {(r.n, str(r.date)) for r in spark.read.parquet(path).collect()} == {(1, "2024-01-01"), (9, "2024-01-02")}
    flat = str(tmp_path / "flat")
    rows.write.parquet(flat)
    sinks.replace(spark.read.parquet(flat).where("n = 1"), f"{flat}-ledger")
    sinks.replace(sinks.current(spark, f"{flat}-ledger").withColumn("n", F.lit(7)), f"{flat}-ledger")
    assert [tuple(r) for r in sinks.current(spark, f"{flat}-ledger").collect()] == [(7, "2024-01-01")]
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert {r.n for r in sinks.drop_old(rows, "date", 1).collect()} == {2}
    text = sinks.markdown(spark.createDataFrame([("S", 2, "b", "u2"), ("S", 1, "a", "u1")], "s string, r int, t string, u string"), "s", "r", "t", "u").first().markdown
    assert text == "## S\n- [a](u1)\n- [b](u2)"


def run(spark, frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [("u", "one", None, True, at(1)), ("u", "two", "s", None, at(3)), ("u", "late", None, None, at(2)), ("v", "x", None, None, at(1))]
    schema = "url string, title string, summary string, relevant boolean, seen_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    state = {r.url: r for r in run(spark, folds.history_upsert(stream()), "history", "update")}
    assert (state["u"].title, state["u"].summary, state["u"].relevant, state["u"].sights, state["u"].first_seen, state["u"].last_seen) == ("two", "s", True, 3, at(1), at(3))
    used = run(spark, folds.rolling_usage(stream().withColumn("one", F.lit(1)), "seen_at", "url", "one", "2 hours"), "usage", "update")
    assert sum(r.n for r in used) == 8
    runs = run(spark, folds.sessions(stream(), "seen_at", "url", "90 minutes", "1 day"), "runs", "complete")
    assert {(r.url, r.n) for r in runs} == {("u", 3), ("v", 1)}
    assert {r.url for r in run(spark, folds.first_sights(stream(), ["url"], "seen_at"), "first", "append")} == {"u", "v"}
