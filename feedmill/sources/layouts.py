"""Items of sites with layouts of their own: one Arrow table function over an HTML tokenizer, driven by a table of rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.functions.html import links

BROADCAST_RULES = 10_000
_TAG, _ENTITY, _BLANK = re.compile(r"<[^>]+>"), re.compile(r"&[a-z]+;", re.I), re.compile(r"\s+")


@dataclass(frozen=True)
class Layout:
    """What makes a link of a page an item.

    url and skip are patterns of its address as written, words one of its title; title is taken from its text (only if unbroken)
    or from an attribute; dates are patterns of year, month and day, tried on the address or on the text of the
    first `date_tag` that follows it; base makes addresses whole; least and most are characters of a title; once
    asks for another address than those before; limit is for a page.
    """

    layout: str
    within: str | None = None
    url: str = ""
    skip: str = ""
    title_from: str = ""
    words: str = ""
    least: int = 1
    most: int = 1_000
    dates: str = ""
    date_tag: str = ""
    base: str = ""
    prefix: str = ""
    once: bool = False
    limit: int = 25


# The layouts of four sites.
_DATED = r"(20\d\d)[-/]?(\d{1,2})[-/]?(\d{1,2})"
SITES = (
    Layout("cctv-finance", url=r"^https?://finance\.cctv\.com/[^\"]+\.shtml$", skip=r"VIDE[A-Za-z0-9]|index\.shtml|node_|/2012/|/2013/", least=4, most=60, dates=r"(\d{4})/(\d{2})/(\d{2})", once=True, limit=25),
    Layout("govcn-policy", within="li", url=r"content_\d+\.htm", least=8, dates=r"(\d{4})-(\d{1,2})-(\d{1,2})", date_tag="span", base="https://www.gov.cn", prefix="【国务院政策】", limit=25),
    Layout("sina-money", skip=r"^javascript:", words="理财|保险|基金|黄金|存款|利率|养老金|资管|信托|债券基金|净值|申购|赎回|寿险|财险|贵金属", least=10, most=60, dates=_DATED, base="https://finance.sina.com.cn", prefix="【财富管理】", limit=20),
    Layout("21jingji", title_from="title", words="房贷|消费贷|普惠|信贷|贷款|按揭|首付|利率|融资|助贷|信用卡|公积金|LPR|银行|金融|债券|存款|人民币|货币|监管", least=10, most=80, dates=_DATED, base="https://www.21jingji.com", prefix="【21财经】", limit=20),
)
ITEM = "page long, position int, title string, url string, excerpt string, day date"


def rules_table(spark: SparkSession, layouts: tuple[Layout, ...] = SITES) -> DataFrame:
    """The layouts as rows; a table of the same columns can stand in its place."""
    kinds = {"least": "int", "most": "int", "limit": "int", "once": "boolean"}
    return spark.createDataFrame([tuple(asdict(x).values()) for x in layouts], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in asdict(layouts[0])))


def clean(raw: str) -> str:
    """Text without tags and named entities, white space made one."""
    return _BLANK.sub(" ", _ENTITY.sub(" ", _TAG.sub("", raw))).strip()


def _day(patterns: str, text: str):
    import datetime

    for found in re.finditer(patterns, text) if patterns else ():
        try:
            return datetime.date(*map(int, found.groups()))
        except ValueError:  # no such day: the next match may be one
            continue
    return None


def items(html: str, rule: dict) -> Iterator[tuple]:
    """position, title, url, excerpt and day of the items of a page."""
    seen: set[str] = set()
    for attributes, text, unbroken, after in links(html, rule["within"] or None):
        if len(seen) >= rule["limit"]:
            return
        href, title = attributes.get("href"), clean(attributes.get(rule["title_from"], "") if rule["title_from"] else text)
        if not href or not (unbroken or rule["title_from"]) or not rule["least"] <= len(title) <= rule["most"]:
            continue
        if (rule["url"] and not re.search(rule["url"], href)) or (rule["skip"] and re.search(rule["skip"], href)) or (rule["words"] and not re.search(rule["words"], title)):
            continue
        url = href if href.startswith("http") or not rule["base"] else rule["base"] + (href[1:] if href.startswith("./") else href)
        if rule["once"] and url in seen:
            continue
        dated = next((x for tag, x in after if tag == rule["date_tag"]), "") if rule["date_tag"] else url
        yield len(seen), title, url, rule["prefix"] + title if rule["prefix"] else None, _day(rule["dates"], dated)
        seen.add(url if rule["once"] else f"{len(seen)}")


def _table_function():
    @F.arrow_udtf(returnType=ITEM)
    class SiteItems:
        """Of each row of (page, html, and a layout's columns) the items that the layout finds."""

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            names, rows = [c for c in batch.schema.names if c not in ("page", "html")], []
            rules = batch.select(names).to_pylist()
            for page, html, rule in zip(batch.column("page").to_pylist(), batch.column("html"), rules, strict=True):
                rows += [(page, *item) for item in items(html.as_py() or "", rule)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.date32())
            yield pa.table({name: pa.array(column, kind) for name, column, kind in zip(("page", "position", "title", "url", "excerpt", "day"), columns, kinds, strict=True)})

    return SiteItems


def site_items(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """ITEM of pages (page, html, layout) under the rules of their layout; pages of a layout without rules have none.

    Null and empty pages have no items; broken markup gives what can be read; other columns of pages are ignored. The
    rules are broadcast if they are BROADCAST_RULES rows at most, else joined by shuffle.
    """
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    own = pages.select(F.col("page").cast("long").alias("page"), F.col("html").cast("string").alias("html"), "layout")
    return _table_function()(own.join(F.broadcast(rules) if few else rules, "layout").asTable())
