"""What filings say, as Columns: codes and exchanges, names of companies, days, structures, and what kind of item they are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmill.functions import dates, lexicon

# Beginnings of codes by exchange, forms of companies, and words of a contractual structure that has ended.
EXCHANGES = {"szse": ("300", "301", "002", "000", "003"), "sse": ("600", "601", "603", "605", "688", "689"), "bse": ("8", "4", "92")}
FORMS = "股份有限公司 有限责任公司 有限公司 控股 集團 集团 國際 国际 科技 實業 实业 發展 发展 公司".split()
LATIN_FORMS = "holdings? group international incorporated inc company co limited ltd corp plc".split()
ENDED = "已终止 已終止 terminated".split()


def exchange_of(code: Column, exchanges: Mapping[str, Sequence[str]] = EXCHANGES) -> Column:
    """Exchange by how a code begins, null for others."""
    out = F.lit(None).cast("string")
    for name, starts in reversed(exchanges.items()):
        out = F.when(code.rlike(f"^({'|'.join(starts)})"), name).otherwise(out)
    return out


def stock_code(text: Column) -> Column:
    """First six digits in parentheses or after the word for code; null without."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:\(|码[：:]?\s*|股票代码[：:]?\s*)(\d{6})", 1), F.lit(""))


def company_key(name: Column) -> Column:
    """A company's name without case, parentheses, share class, legal form and signs; null is ''."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[（(][^）)]*[）)]", "")
    s = F.regexp_replace(s, r"[-–—]\s*[wbs]\b", "")
    s = F.regexp_replace(F.regexp_replace(s, "|".join(FORMS), ""), rf"\b(?:{'|'.join(LATIN_FORMS)})\b\.?", "")
    return F.regexp_replace(s, r"[^a-z0-9\x{4e00}-\x{9fff}]", "")


def code_key(code: Column, least: int = 4) -> Column:
    """Digits of a code without leading zeros; '' if fewer than `least` are left."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(code, F.lit("")), r"[^0-9]", ""), "^0+", "")
    return F.when(F.length(digits) >= least, digits).otherwise("")


def application_id(*urls: Column) -> Column:
    """Number of the application that the first of several links with one names; null without."""
    found = lambda u: F.nullif(F.regexp_extract(F.coalesce(u, F.lit("")), r"(?i)/app/(?:sehk|gem)/\d{4}/(\d{4,})", 1), F.lit(""))
    return F.coalesce(*map(found, urls))


def board(path: Column) -> Column:
    """gem or main by a link's path; '' for others."""
    p = F.lower(F.coalesce(path, F.lit("")))
    return F.when(p.rlike("^gem|/gem/"), "gem").when(p.rlike("^sehk|/sehk/"), "main").otherwise("")


def day_of(text: Column) -> Column:
    """A day written as dd/mm/yyyy or with eight digits in a row; null for others."""
    return F.coalesce(F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(text, "dd/MM/yyyy")), F.try_to_date(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{8})", 1), F.lit("")), "yyyyMMdd"))


def day_of_stamp(millis: Column, zone: str = dates.REPORT_ZONE) -> Column:
    """Calendar day in the zone of milliseconds since 1970."""
    return dates.date_key(F.timestamp_millis(millis), zone)


def structure(text: Column, words: Sequence[str], ended: Sequence[str] = tuple(ENDED)) -> Column:
    """unverified without a text, none without one of the words, historical if the text also says that it ended, else current."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", "unverified").when(~F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)), "none").when(lexicon.hits(t, ended), "historical").otherwise("current")


def evidence_label(verdict: Column, domicile: Column, city_hits: Column, source: Column, least: int = 1) -> Column:
    """sure for a positive verdict with domicile, cities and source; open for one without, or an open verdict; '' for others."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    whole = filled(domicile) & filled(source) & (F.coalesce(city_hits, F.lit(0)) >= least)
    return F.when(verdict == "sure", F.when(whole, "sure").otherwise("open")).when(verdict == "open", "open").otherwise("")


def window_days(submitted: Column, found: Column, changed: Column) -> Column:
    """Days by which an item counts as recent: when it was submitted, or else found, and when it last changed."""
    return F.array_distinct(F.array_compact(F.array(F.coalesce(submitted, found), changed)))


def in_any_window(days: Column, today: Column, most: int) -> Column:
    """Whether one of the days lies 0 to `most` days back."""
    return F.exists(days, lambda d: dates.within_gap(d, today, most))


def routed(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """keep, move or drop by the first rule (action, words) that hits: the order of a decision tree."""
    out = F.lit(default)
    for action, words in reversed(rules):
        out = F.when(lexicon.hits(text, words), action).otherwise(out)
    return out


def has_stale_year(title: Column, published: Column, year: Column, back: int = 2) -> Column:
    """Whether an item without a day of its own names a year that lies `back` years or more before."""
    years = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return published.isNull() & F.exists(years, lambda y: y.cast("int") <= year - back)


def is_listing(code: Column, name: Column, day: Column) -> Column:
    """Whether code, name and a day written as yyyy-mm-dd are all there."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return filled(code) & filled(name) & F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def region_of(registered: Column, city: Column, address: Column, cities: Sequence[str], province: str) -> Column:
    """gz, gd, nation or '': a registered issuer by its city, or else by its address, and at least of the province; others by their address."""
    place, at = F.coalesce(city, F.lit("")), F.coalesce(address, F.lit(""))
    near = F.exists(F.array(*map(F.lit, cities)), lambda c: F.contains(at, F.concat(c, F.lit("市"))) | F.startswith(at, c))
    own = F.when(place != "", F.when(F.size(lexicon.contained(place, cities)) > 0, "gz").otherwise("gd")).when(near, "gz").otherwise("gd")
    return F.when(F.coalesce(registered, F.lit(False)), own).when(at == "", "").when(near, "gz").when(F.contains(at, F.lit(province)), "gd").otherwise("nation")
