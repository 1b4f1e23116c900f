"""Links as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track where a reader came from.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "source", "spm", "from", "share_source", "share_medium", "_channel", "nsukey", "ncid", "ved",
)

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Scheme and host in lower case, without www., tracking parameters, fragment and closing slash, parameters sorted by name; what is no link stays."""
    part = lambda n: F.regexp_extract(url, _PARTS, n)
    name = lambda p: F.substring_index(p, "=", 1)
    params = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(name(p)).isin(*tracking))
    order = F.array_sort(F.transform(params, lambda p, i: F.struct(name(p).alias("name"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(order, lambda x: x["p"]), "&")
    path = F.when(part(3) == "", "/").when(F.length(part(3)) > 1, F.regexp_replace(part(3), "/$", "")).otherwise(part(3))
    out = F.concat(F.lower(part(1)), F.lit("://"), F.regexp_replace(F.lower(part(2)), r"^www\.", ""), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(_PARTS), out).otherwise(url)


def same_url(a: Column, b: Column) -> Column:
    return canonical_url(a) == canonical_url(b)


def host(url: Column) -> Column:
    """Host in lower case without www., null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _PARTS, 2)), r"^www\.", ""), F.lit(""))


def date_from_url(url: Column) -> Column:
    """First year-month-day in a link's digits that is a date between 2000 and 2100."""
    found = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"(20\d\d[-/_]?(?:0[1-9]|1[0-2])[-/_]?(?:0[1-9]|[12]\d|3[01]))"), F.lit(1))
    days = F.transform(found, lambda d: F.try_to_date(F.regexp_replace(d, r"[-/_]", ""), "yyyyMMdd"))
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))


def query_parameter(url: Column, name: str) -> Column:
    """Value of a parameter as it stands, null if it is absent."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
