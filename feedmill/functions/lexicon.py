"""Word lists and ordered rules, compiled on the driver to Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmill.functions.text import bound

_META = re.compile(r"[\\^$.|?*+()\[\]{}]")


def alternation(words: Sequence[str]) -> str:
    """One pattern for any of the words: those with signs of a regex as such if they compile, others literally."""
    parts = []
    for word in words:
        if _META.search(word):
            try:
                re.compile(word)
                parts.append(f"(?:{word})")
                continue
            except re.error:
                pass
        parts.append(re.escape(word))
    return "(?i)" + "|".join(parts)


def hits(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words stands in a text; never for an empty list or null."""
    return F.coalesce(text.rlike(alternation(words)), F.lit(False)) if words else F.lit(False)


def contained(text: Column, words: Sequence[str]) -> Column:
    """Those of the words that stand in a text, in the list's order."""
    if not words:
        return F.array().cast("array<string>")
    return bound(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.lower(w))))


def first_match(text: Column, rules: Mapping[str, Sequence[str]], default: str | None = None) -> Column:
    """Name of the first rule that hits."""
    out = F.lit(default)
    for name, words in reversed(rules.items()):
        out = F.when(hits(text, words), name).otherwise(out)
    return out


def first_value(text: Column, rules: Sequence[tuple[Sequence[str], float]], default: float = 0.0) -> Column:
    """Number of the first rule that hits."""
    out = F.lit(float(default))
    for words, value in reversed(rules):
        out = F.when(hits(text, words), float(value)).otherwise(out)
    return out


def all_matches(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """Names of all rules that hit, in order."""
    return F.array_compact(F.array(*(F.when(hits(text, words), name) for name, words in rules.items())))


def cue_sum(text: Column, cues: Sequence[tuple[Sequence[str], float]], most: float = 100.0) -> Column:
    """Sum of the weights of the cue groups that hit, at most `most`."""
    total = F.lit(0.0)
    for words, weight in cues:
        total = total + F.when(hits(text, words), float(weight)).otherwise(0.0)
    return F.least(total, F.lit(float(most)))


def guarded(text: Column, strict: Sequence[str], loose: Sequence[str], guard: Sequence[str]) -> Column:
    """Whether a strict word hits, or a loose one together with a guard."""
    return hits(text, strict) | (hits(text, loose) & hits(text, guard))


def vetoed(value: Column, text: Column, words: Sequence[str], other: float = 0.0) -> Column:
    """value, but `other` where one of the words hits."""
    return F.when(hits(text, words), float(other)).otherwise(value)
