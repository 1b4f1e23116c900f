"""Text as Columns: normal forms, n-grams, set similarities, ids, token estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def norm_text(text: Column) -> Column:
    """Letters and digits only, lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, ""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: within a lambda of its own an expression would be computed for every element."""
    return F.transform(F.array(value), use)[0]


def title_bigrams(text: Column) -> Column:
    """Distinct two-character pieces of the normal form; a single character stands for itself, nothing gives an empty array."""

    def pieces(chars: Column) -> Column:  # by place in an array: a substring counts from the text's start each time
        pairs = F.transform(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))), lambda c, i: F.concat(c, F.get(chars, i + 1)))
        return F.when(F.size(chars) > 1, F.array_distinct(pairs)).otherwise(chars)

    return bound(F.filter(F.split(norm_text(text), ""), lambda c: c != ""), pieces)


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != ""))


def _overlap(a: Column, b: Column, use: Callable[[Column], Column]) -> Column:
    """use(sizes and number of shared values of two arrays, as x.a, x.b, x.n), each array and the intersection computed once."""
    count = lambda p: F.struct(F.size(p["a"]).alias("a"), F.size(p["b"]).alias("b"), F.size(F.array_intersect(p["a"], p["b"])).alias("n"))
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda p: bound(count(p), use))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Shared by all of two arrays of distinct values; two empty ones give `empty`."""
    return _overlap(a, b, lambda x: F.when(x["a"] + x["b"] == 0, F.lit(empty)).otherwise(x["n"] / F.greatest(x["a"] + x["b"] - x["n"], F.lit(1))))


def dice(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Twice the shared by the sum of sizes; two empty arrays give `empty`."""
    return _overlap(a, b, lambda x: F.when(x["a"] + x["b"] == 0, F.lit(empty)).otherwise(2 * x["n"] / F.greatest(x["a"] + x["b"], F.lit(1))))


def aspects(line: Column, lead: str = "^.*?：", ends: str = "[；;]") -> Column:
    """Parts of a line between signs, without what leads it in, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(line, F.lit("")), lead, ""), ends), lambda p: F.trim(p)), lambda p: p != "")


def clip(value: Column, most: int = 90, end: str = "…") -> Column:
    """A text with white space made one, cut after so many characters; null is empty."""
    return bound(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(end))).otherwise(t))


def _pairs_of(value: Column) -> Column:
    """Neighbouring letters and digits of a text, in order, with repeats."""
    chars = F.filter(F.split(F.regexp_replace(F.coalesce(value, F.lit("")), NOT_WORD, ""), ""), lambda c: c != "")
    return bound(chars, lambda c: F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), lambda x, i: F.concat(x, F.get(c, i + 1))))


def uncovered(topics: Column, spoken: Column, least: int = 3, ends: str = "[。；;]") -> Column:
    """Those of an array of topics of which no clause of a text holds `least` pairs of neighbouring letters or more; none if the text is empty. Topics without letters are covered."""

    def left(x: Column) -> Column:
        heard = lambda own: F.exists(x["clauses"], lambda c: F.size(F.filter(own, lambda p: F.array_contains(c, p))) >= least)
        each = F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.struct(F.trim(t).alias("topic"), _pairs_of(t).alias("pairs"), (F.regexp_replace(t, NOT_WORD, "") != "").alias("told")))
        return F.transform(F.filter(each, lambda e: e["told"] & ~heard(e["pairs"])), lambda e: e["topic"])

    clauses = F.transform(F.filter(F.split(F.coalesce(spoken, F.lit("")), ends), lambda c: F.regexp_replace(c, NOT_WORD, "") != ""), _pairs_of)
    said = F.trim(F.coalesce(spoken, F.lit(""))) != ""
    return F.when(said, bound(F.struct(clauses.alias("clauses")), left)).otherwise(F.array().cast("array<string>"))


def most_repeated(a: Column, b: Column) -> Column:
    """Struct of score, a and b: the two parts of two arrays of texts that are most alike by Jaccard of their bigrams, the first of equals; null if either is empty."""

    def best(x: Column) -> Column:
        each = F.transform(x["a"], lambda p: F.struct(p.alias("text"), title_bigrams(p).alias("grams")))
        others = F.transform(x["b"], lambda p: F.struct(p.alias("text"), title_bigrams(p).alias("grams")))
        pairs = F.flatten(F.transform(each, lambda p: F.transform(others, lambda q: F.struct(F.when(F.size(p["grams"]) == 0, 0.0).otherwise(jaccard(p["grams"], q["grams"])).alias("score"), p["text"].alias("a"), q["text"].alias("b")))))
        return bound(pairs, lambda s: F.get(F.filter(s, lambda y: y["score"] == F.array_max(F.transform(s, lambda z: z["score"]))), F.lit(0)))

    return bound(F.struct(a.alias("a"), b.alias("b")), best)


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard of bigrams; two titles without letters are alike."""
    return jaccard(title_bigrams(a), title_bigrams(b))


def title_similarity_dice(a: Column, b: Column) -> Column:
    """Dice of bigrams; two titles without letters are alike."""
    return dice(title_bigrams(a), title_bigrams(b))


def similarity(a: Column, b: Column) -> Column:
    """Dice of bigrams; titles without letters are not alike."""
    return dice(title_bigrams(a), title_bigrams(b), empty=0.0)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of tokens; texts without any are not alike."""
    return jaccard(tokens(a), tokens(b), empty=0.0)


def coverage(a: Column, b: Column) -> Column:
    """Share of a that b holds; an empty a gives 0."""
    return _overlap(a, b, lambda x: F.when(x["a"] == 0, F.lit(0.0)).otherwise(x["n"] / F.greatest(x["a"], F.lit(1))))


def best_dice(title: Column, titles: Column) -> Column:
    """Greatest Dice of a title with an array of titles; 0 for none."""
    return bound(title_bigrams(title), lambda own: F.coalesce(F.array_max(F.transform(titles, lambda t: dice(own, title_bigrams(t)))), F.lit(0.0)))


def clip(text: Column, size: int = 90) -> Column:
    """White space collapsed; longer texts are cut and end in an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("…"))).otherwise(t)


def content_fingerprint(text: Column, least: int = 80) -> Column:
    """Body without white space, lower-cased; '' if that has at most `least` characters."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    return F.when(F.length(t) > least, t).otherwise("")


def title_key(text: Column, size: int = 16) -> Column:
    """First characters of a title without white space."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), 1, size)


def split_clauses(text: Column) -> Column:
    """Clauses between punctuation, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.,;:!?\n，。；：！？、]+"), lambda c: F.trim(c)), lambda c: c != "")


def scrub_sentences(text: Column, banned: str) -> Column:
    """Text without the sentences that match a pattern."""
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。！？\n])"), lambda s: ~s.rlike(banned)), "")


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, common entities resolved, white space collapsed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def element_ids(html: Column) -> Column:
    """Values of the id attributes of a page, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'\sid="([^"]*)"'), F.lit(1))


def djb2(text: Column) -> Column:
    """h = 33 h + character over the characters from 5381, modulo 2^32, as a long."""
    chars = F.split(F.coalesce(text, F.lit("")), "")
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)) % F.lit(4294967296))


def item_id(url: Column, prefix: str = "itm-") -> Column:
    """Stable id of a link: djb2 in base 36; an empty link has the id 0."""
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(f"{prefix}0")).otherwise(F.concat(F.lit(prefix), F.lower(F.conv(djb2(url), 10, 36))))


def estimate_tokens(text: Column) -> Column:
    """One token a CJK character, one for every four other characters begun."""
    t = F.coalesce(text, F.lit(""))
    rest = F.length(F.regexp_replace(t, r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]", ""))
    return (F.length(t) - rest + F.ceil(rest / 4)).cast("long")


def format_tokens(characters: Column, per_token: float = 1.5) -> Column:
    """Characters as tokens, in thousands (K) or millions (M) with one digit."""
    n = characters / F.lit(per_token)
    return F.when(n >= 1e6, F.concat(F.round(n / 1e6, 1).cast("string"), F.lit("M"))).when(n >= 1e3, F.concat(F.round(n / 1e3, 1).cast("string"), F.lit("K"))).otherwise(F.round(n, 0).cast("long").cast("string"))


def numeric_anchors(text: Column, units: str = "%|percent|million|billion|points|years?|months?|days?") -> Column:
    """Distinct numbers with their units, without the space between."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)(\d+(?:\.\d+)?\s*(?:{units}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))))


def balanced_block(text: Column) -> Column:
    """The block that the first { or [ of a text opens, up to the sign that balances it outside of strings; null if none does.

    One pass over the characters: depth, whether within a string, whether after a backslash, and where the block ends.
    """

    def scan(t: Column) -> Column:
        first = F.regexp_instr(t, F.lit(r"[\{\[]"))
        rest = F.substring(t, first, F.length(t))

        def step(s: Column, c: Column) -> Column:
            opens, closes = F.when(s["left"] == "{", c == "{").otherwise(c == "["), F.when(s["left"] == "{", c == "}").otherwise(c == "]")
            depth = s["depth"] + F.when(s["string"], 0).when(opens, 1).when(closes, -1).otherwise(0)
            string = F.when(s["string"], (c != '"') | s["escape"]).otherwise(c == '"')
            escape = s["string"] & ~s["escape"] & (c == "\\")
            on = F.struct(s["left"].alias("left"), depth.cast("int").alias("depth"), string.alias("string"), escape.alias("escape"), (s["n"] + 1).alias("n"), (depth == 0).alias("done"))
            return F.when(s["done"], s).otherwise(on)

        start = F.struct(F.substring(rest, 1, 1).alias("left"), F.lit(0).alias("depth"), F.lit(False).alias("string"), F.lit(False).alias("escape"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        chars = F.filter(F.split(rest, ""), lambda c: c != "")
        return F.when(first > 0, bound(F.aggregate(chars, start, step), lambda s: F.when(s["done"], F.substring(rest, F.lit(1), s["n"]))))

    return bound(F.coalesce(text, F.lit("")), scan)


def first_json(text: Column) -> Column:
    """The first balanced {...} or [...] block of a text, without a code fence around it, if it parses as JSON; else null."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    inner = F.regexp_extract(bare, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    block = balanced_block(F.when(inner != "", inner).otherwise(bare))
    return F.when(F.try_parse_json(block).isNotNull(), block)


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves toward positive infinity."""
    return F.floor(x + 0.5)


def clip_at_clause(text: Column, most: int, marks: str = "，；、") -> Column:
    """A longer text cut at `most` characters, or before the last mark in the second half of those."""
    cut = F.substring(text, 1, most)
    tail = F.length(F.regexp_extract(cut, f"([{marks}][^{marks}]*)$", 1))
    at = F.lit(most) - tail
    return F.when(F.length(text) <= most, text).when((tail > 0) & (at >= most // 2), F.substring(cut, F.lit(1), at)).otherwise(cut)


def without_prefix(text: Column, prefix: str) -> Column:
    """Trimmed text without a fixed beginning."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.startswith(prefix), F.trim(F.substring(t, len(prefix) + 1, 1 << 20))).otherwise(t)


def longest_common_span(a: Column, b: Column, least: int = 2) -> Column:
    """Length of the longest run of characters that two short texts share, 0 if it is shorter than `least`: one row of the usual table for each character."""

    def table(p: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            row = F.transform(p["b"], lambda x, j: F.when(x == c, F.when(j == 0, 1).otherwise(F.coalesce(F.get(s["row"], j - 1), F.lit(0)) + 1)).otherwise(0))
            return bound(row, lambda r: F.struct(r.alias("row"), F.greatest(s["best"], F.coalesce(F.array_max(r), F.lit(0))).alias("best")))

        start = F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("best"))
        return F.aggregate(p["a"], start, step, lambda s: F.when(s["best"] >= least, s["best"]).otherwise(0))

    chars = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), ""), lambda c: c != "")
    return bound(F.struct(chars(a).alias("a"), chars(b).alias("b")), table)


def mapped_tags(tags: Column, names: dict[str, str]) -> Column:
    """Tags followed by the group that each stands for, without repeats."""
    groups = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.array_distinct(F.concat(tags, F.array_compact(F.transform(tags, lambda t: F.element_at(groups, t)))))
