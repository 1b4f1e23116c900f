"""Wording of market reports as Columns: index moves, their agreement with quotes, titles of reports."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions.text import bound


def direction(clause: Column, up: str, down: str) -> Column:
    """1 or -1 by the last word of a rise or a fall in a clause, 0 without one."""
    words = F.regexp_extract_all(clause, F.lit(f"({up}|{down})"), F.lit(1))
    return bound(F.element_at(F.concat(F.array(F.lit("")), words), -1), lambda w: F.when(w == "", 0).when(w.rlike(f"^(?:{up})$"), 1).otherwise(-1))


def index_moves(clauses: Column, names: Sequence[str], up: str, down: str) -> Column:
    """name and signed pct of each index whose move a clause tells; a clause without a direction tells none."""
    pattern = rf"((?:{'|'.join(names)})[^%]{{0,10}}?\d+(?:\.\d+)?\s*%)"

    def of(clause: Column) -> Column:
        way = direction(clause, up, down)
        told = F.regexp_extract_all(clause, F.lit(pattern), F.lit(1))
        return F.when(way == 0, F.array().cast("array<struct<name:string,pct:double>>")).otherwise(
            F.transform(told, lambda m: F.struct(F.regexp_extract(m, f"^({'|'.join(names)})", 1).alias("name"), (way * F.regexp_extract(m, r"(\d+(?:\.\d+)?)\s*%$", 1).cast("double")).alias("pct")))
        )

    return F.flatten(F.transform(clauses, of))


def is_move_only(clause: Column, names: Sequence[str]) -> Column:
    """Whether a clause names an index and, without its moves, blanks and signs, has fewer than four characters left."""
    either = "|".join(names)
    rest = F.regexp_replace(F.regexp_replace(clause, rf"(?:{either})[^%]{{0,10}}?\d+(?:\.\d+)?\s*%", ""), r"[\s\p{P}\p{S}]", "")
    return clause.rlike(either) & (F.length(rest) < 4)


def conflicts(moves: Column, quotes: Column, tolerance: float = 0.05) -> Column:
    """Whether a told move differs from the quote (name, pct) of the first index whose name holds or is held by its own; indices without a quote don't."""

    def differs(m: Column) -> Column:
        quote = F.get(F.filter(quotes, lambda q: F.contains(q["name"], m["name"]) | F.contains(m["name"], q["name"])), F.lit(0))
        return F.coalesce(F.abs(quote["pct"] - m["pct"]) > tolerance, F.lit(False))

    return F.exists(moves, differs)


def overview(quotes: Column) -> Column:
    """A sentence of the quotes (name, value, change); null without any."""
    each = F.transform(quotes, lambda q: F.concat(q["name"], F.lit("收报"), q["value"], F.lit("点"), F.when(F.coalesce(q["change"], F.lit("")) == "", "").otherwise(F.concat(F.lit("（"), q["change"], F.lit("）")))))
    return F.when(F.size(quotes) > 0, F.concat(F.array_join(each, "；"), F.lit("。")))


def recap_card(clauses: Column, quotes: Column, names: Sequence[str], up: str, down: str, noise: str, most: int = 5) -> Column:
    """Struct of overview and sectors from a report's clauses; null if fewer than two clauses tell anything.

    Clauses that are short, noise or cut off tell nothing. Sectors are those that don't just repeat a move. The
    overview is that of the quotes (name, value, change, pct), but where they conflict with the report its own moves.
    """
    told = F.filter(clauses, lambda c: (F.length(c) >= 4) & ~c.rlike(noise) & ~c.rlike(r"(?:^|[^\d])[多少]$"))

    def card(kept: Column) -> Column:
        sectors = F.slice(F.filter(kept, lambda c: ~is_move_only(c, names)), 1, most)
        moving = F.filter(kept, lambda c: F.size(index_moves(F.array(c), names, up, down)) > 0)
        own = F.concat(F.when(F.size(moving) > 0, F.array_join(moving, "，")).otherwise(kept[0]), F.lit("。"))
        said = F.when(conflicts(index_moves(kept, names, up, down), quotes), own).otherwise(F.coalesce(overview(quotes), kept[0]))
        return F.when(F.size(kept) >= 2, F.struct(said.alias("overview"), sectors.alias("sectors")))

    return bound(told, card)


def is_recap(title: Column, recap: str, intraday: str) -> Column:
    """Whether a title is a report after the close and not one of the running day."""
    return F.coalesce(title.rlike(recap) & ~title.rlike(intraday), F.lit(False))


def recap_order(title: Column, clauses: Column, broad: str) -> list[Column]:
    """Order of reports: the broader, the more clauses, the longer title first."""
    return [F.desc(F.when(title.rlike(broad), 2).otherwise(1)), F.desc(F.size(clauses)), F.desc(F.length(title))]


@dataclass(frozen=True)
class StockNews:
    """What tells news on markets from news on a single share: words that never stay, companies that always do, a share's code, words of markets, words of a share; in this order."""

    never: Sequence[str] = ("异动",)
    companies: Sequence[str] = ()
    code: str = r"\(\d{4,6}(?:\.\w+)?\)|\([A-Z]{2,5}\.[A-Z]{2}\)"
    markets: Sequence[str] = ("大盘", "板块", "指数", "A股", "港股", "美股", "央行", "政策")
    shares: Sequence[str] = ("股价", "财报", "评级", "回购", "涨停", "跌停", "earnings", "shares", "target price")


def keep_stock_news(title: Column, v: StockNews = StockNews()) -> Column:  # noqa: B008
    """Whether a title on stocks stays: companies and markets do, single shares don't, what tells neither does. Words count as they are written; an empty title stays."""

    def made(t: Column) -> Column:
        stands = lambda words: F.lit(False) if not words else t.rlike("|".join(map(re.escape, words)))
        return F.when(t == "", True).when(stands(v.never), False).when(stands(v.companies), True).when(t.rlike(v.code), False).when(stands(v.markets), True).otherwise(~stands(v.shares))

    return bound(F.coalesce(title, F.lit("")), made)


def filter_stock_news(rows: DataFrame, title: str, category: str, stocks: str = "stocks", v: StockNews = StockNews()) -> DataFrame:  # noqa: B008
    """rows without single-share news; only the category of stocks is looked at, a null category is another."""
    return rows.where(~F.coalesce(F.col(category) == stocks, F.lit(False)) | keep_stock_news(F.col(title), v))
