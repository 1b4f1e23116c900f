"""Identity of events as Columns: anchors, facts, themes, and whether two texts tell of the same event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmill.functions.text import _overlap, bound, dice, title_bigrams
from feedmill.functions.vocabulary import Events

#: Shared anchors of one event, the similarity at which two records are one, and that which shared subjects and themes must support.
SHARED, MATCH, SUPPORT = 2, 0.5, 0.3


def _words(text: Column, words: Sequence[str], mark: str = "") -> Column:
    """Those of the words that a text contains, as they are written, with a mark before each."""
    if not words:
        return F.array().cast("array<string>")
    return F.transform(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), lambda w: F.concat(F.lit(mark), w))


def fingerprint(title: Column, v: Events) -> Column:
    """Distinct anchors of a title after wordings are made one, and its numbers with their units, marked #."""

    def made(t: Column) -> Column:
        pattern = rf"(\d+(?:\.\d+)?\s*(?:{v.anchor_units}))"
        numbers = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit("#"), F.regexp_replace(x, r"\s+", "")))
        return F.array_distinct(F.concat(_words(t, v.anchors), numbers))

    text = F.coalesce(title, F.lit(""))
    for wording, one in v.synonyms:
        text = F.regexp_replace(text, wording, one)
    return bound(text, made)


def subjects(anchors: Column, v: Events) -> Column:
    """Anchors that say what an event is: neither a number nor a place or authority."""
    return F.filter(anchors, lambda a: ~a.startswith("#") & ~a.isin(*v.generic))


def shared_subjects(a: Column, b: Column, v: Events) -> Column:
    """Number of subjects that two arrays of anchors share."""
    return F.size(F.array_intersect(subjects(a, v), subjects(b, v)))


def same_event_anchors(a: Column, b: Column, v: Events, least: int = SHARED) -> Column:
    """Whether anchors share `least` or more, and a subject among them."""
    return bound(F.array_intersect(a, b), lambda both: (F.size(both) >= least) & (F.size(subjects(both, v)) >= 1))


def same_event(a: Column, b: Column, v: Events, least: int = SHARED) -> Column:
    """Whether two titles tell of the same event; one without anchors never does."""
    return same_event_anchors(fingerprint(a, v), fingerprint(b, v), v, least)


def facts(text: Column, v: Events) -> Column:
    """Distinct numbers with units (#), stages (!) and bodies (@) of a text."""

    def made(t: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(t, F.lit(rf"(\d+(?:\.\d+)?\s*(?:{v.fact_units}))"), F.lit(1)), short)
        return F.array_distinct(F.concat(numbers, _words(t, v.stages, "!"), _words(t, v.bodies, "@")))

    def short(x: Column) -> Column:
        out = F.regexp_replace(x, r"\s+", "")
        for unit, one in v.short_units.items():
            out = F.replace(out, F.lit(unit), F.lit(one))
        return F.concat(F.lit("#"), out)

    return bound(F.coalesce(text, F.lit("")), made)


def candidate_anchors(title: Column, text: Column, v: Events) -> Column:
    """Anchors of a title, and those of its text but for places."""
    return F.array_distinct(F.concat(fingerprint(title, v), F.filter(fingerprint(text, v), lambda a: ~a.isin(*v.places))))


def candidate_facts(title: Column, text: Column, v: Events) -> Column:
    """Facts of a title, and those of its text but for places."""
    return F.array_distinct(F.concat(facts(title, v), F.filter(facts(text, v), lambda a: ~a.isin(*(f"@{p}" for p in v.places)))))


def themes(text: Column, v: Events) -> Column:
    """Names of the themes one of whose words a text contains."""
    t = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)), name) for name, words in v.themes.items())))


def event_id(anchors: Column) -> Column:
    """The two least number anchors and the three least others, joined by |; '' without any."""
    part = lambda marked, n: F.slice(F.array_sort(F.filter(anchors, lambda a: a.startswith("#") == F.lit(marked))), 1, n)
    return F.array_join(F.concat(part(True, 2), part(False, 3)), "|")


def anchor_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct anchors; 0 if one is empty."""
    return _overlap(a, b, lambda x: F.when((x["a"] == 0) | (x["b"] == 0), F.lit(0.0)).otherwise(x["n"] / F.greatest(x["a"] + x["b"] - x["n"], F.lit(1))))


def candidate_coverage(a: Column, b: Column, least: int = SHARED) -> Column:
    """Share of a's anchors that b has, where both have and they share `least` or more; else 0."""
    return _overlap(a, b, lambda x: F.when((x["a"] < least) | (x["b"] < least) | (x["n"] < least), F.lit(0.0)).otherwise(x["n"] / F.greatest(x["a"], F.lit(1))))


def shared_tags(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def match_score(anchors: Column, record_anchors: Column, title_dice: Column, tags: Column, record_tags: Column, same_url: Column, v: Events, soft: float = 0.35, hard_eps: float = 0.01) -> Column:
    """How surely a candidate is a remembered event: 1 for its link; the best of anchors, title and coverage; from SUPPORT on a shared subject and theme, or two themes, lift it to MATCH."""

    def made(x: Column) -> Column:
        hard = F.greatest(x["j"], x["t"], F.when(x["j"] >= SUPPORT, x["c"]).otherwise(0.0))
        lifted = F.when((hard >= SUPPORT) & (((x["s"] >= 1) & (x["g"] >= 1)) | (x["g"] >= 2)), F.lit(MATCH)).otherwise(F.greatest(hard, F.when(x["g"] >= 2, soft).otherwise(0.0)))
        return F.when(x["u"], F.lit(1.0)).when(hard >= MATCH, F.greatest(hard, F.lit(MATCH + hard_eps))).otherwise(lifted)

    known = F.struct(
        anchor_jaccard(anchors, record_anchors).alias("j"), title_dice.alias("t"), candidate_coverage(anchors, record_anchors).alias("c"), shared_subjects(anchors, record_anchors, v).alias("s"),
        shared_tags(tags, record_tags).alias("g"), F.coalesce(same_url, F.lit(False)).alias("u"),
    )
    return bound(known, made)


def novelty(new_facts: Column, old_facts: Column, new_grams: Column, old_grams: Column, title_overlap: Column, v: Events) -> Column:
    """What a candidate adds to a remembered event, from 0 to 1: 0.45 share of new facts + 0.35 share of new pieces + 0.2 for a new stage + 0.2 for a new period, less up to 0.45 for a title told before.

    Without remembered facts the share of new ones counts as 0.5 at most.
    """
    marked = lambda a, what: F.filter(a, lambda x: x.rlike(what))
    added = lambda what: F.size(F.array_except(marked(new_facts, what), marked(old_facts, what))) > 0
    n_new, n_old = F.size(new_facts), F.size(old_facts)
    share = F.when(n_new == 0, 0.0).otherwise(F.least(F.size(F.array_except(new_facts, old_facts)) / F.greatest(n_new, n_old, F.lit(1)), F.when(n_old == 0, 0.5).otherwise(1.0)))
    pieces = F.when(F.size(new_grams) == 0, 0.0).otherwise(F.size(F.array_except(new_grams, old_grams)) / F.greatest(F.size(new_grams), F.lit(1)))
    raw = 0.45 * share + 0.35 * pieces + F.when(added("^!"), 0.2).otherwise(0.0) + F.when(added(v.period), 0.2).otherwise(0.0)
    told = F.when(title_overlap > 0.6, F.least((title_overlap - 0.6) / 0.4, F.lit(1.0)) * 0.45).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * (1 - told)))


def can_break_cooldown(novel: Column, override: Column, tier: Column, score: Column, section: Column, n_new_facts: Column) -> Column:
    """Whether a candidate may come before its cooldown ends: new enough, and forced, or a top story of 80 or more, or a risk with new facts."""
    return F.coalesce((novel >= 0.25) & (F.coalesce(override, F.lit(False)) | ((tier == "must_read") & (F.coalesce(score, F.lit(0)) >= 80)) | ((section == "risk") & (n_new_facts > 0))), F.lit(False))


def title_dice(a: Column, b: Column) -> Column:
    return dice(title_bigrams(a), title_bigrams(b))
