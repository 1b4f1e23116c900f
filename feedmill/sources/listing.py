"""Listings in pages as a data source: newest first for batch reads, where a floor on the day stops the paging; archives of numbered pages for streams."""

from __future__ import annotations

import datetime
import json
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import asdict

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from feedmill.sources.feeds import fetched
from feedmill.sources.layouts import SITES, items

SCHEMA = "source_id string, page int, position int, title string, url string, excerpt string, day date"


def page_content(url: str) -> str | None:
    """Content of a page; null if it isn't there. http(s) links are fetched with retries, any other is a file, or a folder whose files are read in order of their names."""
    if url.startswith(("http://", "https://")):
        try:
            return fetched(url).decode("utf-8", "replace")
        except urllib.error.HTTPError as wrong:
            if wrong.code in (404, 410):
                return None
            raise
    store, path = fs.FileSystem.from_uri(url)
    found = store.get_file_info(path)
    if found.type == fs.FileType.NotFound:
        return None
    files = [found] if found.is_file else sorted(store.get_file_info(fs.FileSelector(path)), key=lambda x: x.path)
    parts = []
    for file in files:
        if file.is_file and not file.base_name.startswith(("_", ".")):
            with store.open_input_stream(file.path) as stream:
                parts.append(stream.read().decode("utf-8", "replace"))
    return "".join(parts)


def page_exists(url: str) -> bool:
    """Whether a page is there, without its content where the place can tell."""
    if not url.startswith(("http://", "https://")):
        store, path = fs.FileSystem.from_uri(url)
        return store.get_file_info(path).type != fs.FileType.NotFound
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=30):
            return True
    except urllib.error.HTTPError as wrong:
        if wrong.code in (404, 410):
            return False
    except OSError:
        pass
    return page_content(url) is not None  # a place that knows no HEAD, or an error that may pass


class Page(InputPartition):
    """A source, and the page that is to be read of it; 0 stands for all, from the first."""

    def __init__(self, source: dict, page: int = 0):
        self.source, self.page = source, page


class _Sources:
    """Sources and layouts that the options name."""

    def __init__(self, options: dict):
        self.sources = [s for s in json.loads(options.get("sources", "[]")) if s.get("enabled", True)]
        self.rules = {x["layout"]: x for x in json.loads(options["layouts"])} if "layouts" in options else {x.layout: asdict(x) for x in SITES}
        self.max_pages, self.stale_pages = int(options.get("maxpages", options.get("max_pages", 20))), int(options.get("stalepages", options.get("stale_pages", 2)))

    def link(self, source: dict, page: int) -> str:
        return source["first"] if page == 1 and "first" in source else source["url"].replace("{page}", str(page))

    def content(self, source: dict, page: int) -> str | None:
        return page_content(self.link(source, page))

    def rows(self, source: dict, page: int, html: str) -> list[tuple]:
        return [(source["id"], page, *item) for item in items(html, self.rules[source["layout"]])]


class ListingReader(_Sources, DataSourceReader):
    """A task for each source. Floors on the day and choices of sources are taken from the query's filter."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.floor: datetime.date | None = None
        self.chosen: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if isinstance(one, GreaterThanOrEqual | GreaterThan) and one.attribute == ("day",) and isinstance(one.value, datetime.date):
                low = one.value + datetime.timedelta(days=isinstance(one, GreaterThan))
                self.floor = max(low, self.floor or low)
            elif isinstance(one, EqualTo | In) and one.attribute == ("source_id",):
                names = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.chosen = names if self.chosen is None else self.chosen & names
            else:
                yield one

    def partitions(self) -> list[InputPartition]:
        return [Page(s) for s in self.sources if self.chosen is None or s["id"] in self.chosen] or [Page({})]

    def read(self, partition: Page) -> Iterator[tuple]:
        """Pages until one is missing or empty, all of one is older than the floor, stale_pages in a row name no day, or max_pages are read. What fails is tried again and then fails the task."""
        stale = 0
        for page in range(1, self.max_pages + 1) if partition.source else ():
            html = self.content(partition.source, page)
            rows = self.rows(partition.source, page, html) if html is not None else []
            if not rows:
                return
            newest = max((row[-1] for row in rows if row[-1]), default=None)
            stale = stale + 1 if newest is None else 0
            if self.floor and newest and newest < self.floor or self.floor and stale >= self.stale_pages:
                return
            for row in rows:
                if self.floor is None or (row[-1] and row[-1] >= self.floor):
                    yield row


class ArchiveReader(_Sources, DataSourceStreamReader):
    """Numbered pages that don't change once they are there. The offset is the next page of each source; a batch takes `max_pages` new pages of a source at most.

    Spark doesn't tell a reader where a restarted query stands, so it looks into the offsets of the query's `checkpoint`
    once, and then goes by what it planned itself.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.checkpoint = options.get("checkpoint")
        if not self.checkpoint:
            raise ValueError("a stream of pages needs the option checkpoint, the checkpointLocation of its query")
        self.end: dict[str, int] | None = None

    def _planned(self) -> dict[str, int]:
        """The end of the newest batch that was ever planned."""
        if self.end is None:
            self.end = {}
            store, path = fs.FileSystem.from_uri(self.checkpoint)
            found = store.get_file_info(fs.FileSelector(f"{path.rstrip('/')}/offsets", allow_not_found=True))
            numbers = [int(x.base_name) for x in found if x.is_file and x.base_name.isdigit()]
            for line in (page_content(f"{self.checkpoint.rstrip('/')}/offsets/{max(numbers)}") or "").splitlines()[2:] if numbers else ():
                own = json.loads(line) if line.startswith("{") else {}
                self.end |= {s["id"]: own[s["id"]] for s in self.sources if isinstance(own.get(s["id"]), int)}
        return self.end

    def initialOffset(self) -> dict:
        return {s["id"]: 1 for s in self.sources}

    def latestOffset(self) -> dict:
        out = {}
        for source in self.sources:
            first = page = self._planned().get(source["id"], 1)
            while page < first + self.max_pages and page_exists(self.link(source, page)):
                page += 1
            out[source["id"]] = page
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.end = {k: max(v, self._planned().get(k, 1)) for k, v in end.items()}
        return [Page(s, page) for s in self.sources for page in range(start.get(s["id"], 1), end.get(s["id"], 1))]

    def read(self, partition: Page) -> Iterator[tuple]:
        html = self.content(partition.source, partition.page)
        if html is None:
            raise FileNotFoundError(f"page {partition.page} of {partition.source['id']} is gone")
        yield from self.rows(partition.source, partition.page, html)

    def commit(self, end: dict) -> None:
        pass


class Listing(DataSource):
    """Format "listing". Options: sources (JSON list of id, url with {page}, first, layout, enabled), layouts (JSON list of rules), max_pages, stale_pages; for streams checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    """Registers the format and lets Python sources take filters."""
    spark.dataSource.register(Listing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
