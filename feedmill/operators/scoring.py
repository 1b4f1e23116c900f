"""Keyword funnel and relevance scores; lexicons are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions import lexicon
from feedmill.functions.text import round_half_up


@dataclass(frozen=True)
class Dimension:
    """Strong words hit alone; weak ones with one of the words that go with them, else they are gray; excluded ones veto."""

    strong: Sequence[str] = ()
    weak: Sequence[str] = ()
    together: Sequence[str] = ()
    exclude: Sequence[str] = ()


@dataclass(frozen=True)
class Tracker:
    """Watched matter: priority S, A or B, words that trigger it, words of the title that rule it out."""

    priority: str
    triggers: Sequence[str]
    exclude_title: Sequence[str] = ()
    geo_lock: bool = False


@dataclass(frozen=True)
class Rules:
    global_exclude: Sequence[str] = ()
    geo_exact: Sequence[str] = ()
    geo_risky: Sequence[str] = ()
    dimensions: Mapping[str, Dimension] = field(default_factory=dict)
    trackers: Mapping[str, Tracker] = field(default_factory=dict)


def dimension_hit(text: Column, rule: Dimension) -> Column:
    """strong, weak, gray or null."""
    weak = lexicon.hits(text, rule.weak)
    out = F.when(lexicon.hits(text, rule.strong), "strong").when(weak & lexicon.hits(text, rule.together), "weak").when(weak, "gray")
    return F.when(lexicon.hits(text, rule.exclude), F.lit(None).cast("string")).otherwise(out)


def funnel(rows: DataFrame, title: str, text: str, rules: Rules) -> DataFrame:
    """rows with passes, geo (100, 60, 0), dimensions (array of name and hit), trackers (array of priority and name, best first), funnel_score.

    Only a globally excluded word in the title fails a row. The score is geo plus 2 for each strong and 1 for
    each weak dimension, plus 1000 with a tracker.
    """
    body = F.concat_ws(" ", F.col(title), F.col(text))
    geo = F.when(lexicon.hits(body, rules.geo_exact), 100).when(lexicon.hits(body, rules.geo_risky), 60).otherwise(0)
    out = rows.withColumn("passes", ~lexicon.hits(F.coalesce(F.col(title), F.lit("")), rules.global_exclude)).withColumn("geo", geo)
    found = [F.struct(F.lit(name).alias("name"), dimension_hit(body, rule).alias("hit")) for name, rule in rules.dimensions.items()]
    empty = F.array().cast("array<struct<name:string,hit:string>>")
    out = out.withColumn("dimensions", F.filter(F.array(*found), lambda d: d["hit"].isNotNull()) if found else empty)
    rank = {"S": 0, "A": 1, "B": 2}
    watched = [
        F.when(lexicon.hits(body, t.triggers) & ~lexicon.hits(F.coalesce(F.col(title), F.lit("")), t.exclude_title) & (F.lit(not t.geo_lock) | (F.col("geo") >= 100)), F.struct(F.lit(rank[t.priority]).alias("rank"), F.lit(i).alias("i"), F.lit(t.priority).alias("priority"), F.lit(name).alias("name")))
        for i, (name, t) in enumerate(rules.trackers.items())
    ]
    none = F.array().cast("array<struct<rank:int,i:int,priority:string,name:string>>")
    out = out.withColumn("trackers", F.array_sort(F.array_compact(F.array(*watched))) if watched else none)
    points = F.aggregate("dimensions", F.lit(0), lambda a, d: a + F.when(d["hit"] == "strong", 2).when(d["hit"] == "weak", 1).otherwise(0))
    return out.withColumn("funnel_score", F.col("geo") + points + F.when(F.size("trackers") > 0, 1000).otherwise(0))


def relevance(line: Column, authority: Column, action: Column, locality: Column, factor: Column, regional: Column, override: Column) -> Column:
    """0 to 100: 100 (0.45 line + 0.25 authority + 0.2 action + 0.1 locality), rounded, by age, by 0.72 for mere regional news; an override lifts it to 84."""
    base = round_half_up(100 * (0.45 * line + 0.25 * authority + 0.2 * action + 0.1 * locality))
    aged = round_half_up(round_half_up(base * factor) * F.when(regional, 0.72).otherwise(1.0))
    return F.when(override, F.greatest(aged, F.lit(84))).otherwise(aged).cast("long")


def tier(score: Column, action: Column) -> Column:
    """high from 68 with an action of 0.6, medium from 45, low from 25, else drop."""
    return F.when((score >= 68) & (action >= 0.6), "high").when(score >= 45, "medium").when(score >= 25, "low").otherwise("drop")


def dual(text: Column, one: Sequence[tuple[Sequence[str], float]], two: Sequence[tuple[Sequence[str], float]], least: float = 25) -> Column:
    """Struct of two cue sums and whether both reach `least`."""
    a, b = lexicon.cue_sum(text, one), lexicon.cue_sum(text, two)
    return F.struct(a.alias("one"), b.alias("two"), ((a >= least) & (b >= least)).alias("dual"))
