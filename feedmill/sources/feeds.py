"""A Python data source over registered feeds: one partition for each source, failures as rows and not as a failed read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_id string, status string, error string, position int, title string, url string, published_at string, excerpt string"


class FeedPartition(InputPartition):
    def __init__(self, source_id: str, url: str, kind: str):
        self.source_id, self.url, self.kind = source_id, url, kind


def fetched(url: str, tries: int = 3, fetch: Callable[[str], bytes] | None = None) -> bytes:
    """Content of a link. Network errors and answers 429 or 5xx are tried again; others fail at once."""
    import time
    import urllib.error
    import urllib.request

    def get(link: str) -> bytes:
        with urllib.request.urlopen(link, timeout=30) as answer:
            return answer.read()

    for turn in range(tries):
        try:
            return (fetch or get)(url)
        except urllib.error.HTTPError as wrong:
            if turn + 1 == tries or not (wrong.code == 429 or wrong.code >= 500):
                raise
        except OSError:
            if turn + 1 == tries:
                raise
        time.sleep(0.2 * 2**turn)
    raise ValueError("no try is allowed")


def parsed(kind: str, raw: bytes, most: int = 50) -> list[tuple]:
    """(title, url, published_at, excerpt) of RSS items, or of JSON objects in an array, items or data."""
    if kind == "rss":
        from xml.etree import ElementTree

        get = lambda item, tag: (item.findtext(tag) or "").strip() or None
        return [(get(i, "title"), get(i, "link"), get(i, "pubDate"), get(i, "description")) for i in ElementTree.fromstring(raw).iter("item")]
    import json

    body = json.loads(raw)
    rows = body if isinstance(body, list) else body.get("items") or body.get("data") or []
    return [(r.get("title"), r.get("url") or r.get("link"), r.get("published_at") or r.get("date"), r.get("excerpt")) for r in rows[:most]]


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        import json

        self.sources = json.loads(options.get("sources", "[]"))

    def partitions(self) -> list[InputPartition]:
        return [FeedPartition(s["id"], s["url"], s.get("type", "rss")) for s in self.sources if s.get("enabled", True)] or [FeedPartition("", "", "")]

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        if not partition.source_id:
            return
        try:
            for n, row in enumerate(parsed(partition.kind, fetched(partition.url))):
                yield (partition.source_id, "ok", None, n, row[0], row[1], row[2], row[3])
        except Exception as wrong:  # one source's failure is a row of its own, the others go on
            yield (partition.source_id, "failed", f"{type(wrong).__name__}: {wrong}"[:300], None, None, None, None, None)


class FeedSource(DataSource):
    """spark.read.format("feeds").option("sources", JSON list of id, url, type (rss or api), enabled)."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
