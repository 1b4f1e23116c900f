"""Damaged JSON: a pushdown automaton that copies what is right and inserts as little as makes the rest right."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedmill.functions.text import balanced_block, bound

_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_WORDS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "undefined": "null", "NaN": "null"}
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_HEX = re.compile(r"[0-9a-fA-F]*")


class Repair:
    """One text. States: value, key (or the end of an object), colon, comma (or the end of a container); the stack holds open brackets."""

    def __init__(self, text: str):
        self.text, self.at, self.out, self.stack, self.state = text, 0, [], [], "value"

    def run(self) -> str | None:
        """The first object or array as valid JSON; null if no bracket opens.

        What stands before it and after its end is left out. Closed are strings, literals, numbers and brackets that the
        text leaves open; quotes of other kinds, bare keys and words get double quotes; commas and colons that lack are
        set, superfluous commas go; a key without a value gets null; a bracket that closes another than the
        open one closes those between, one that closes nothing goes.
        """
        first = re.search(r"[{\[]", self.text)
        if not first:
            return None
        self.at = first.start()
        while self.at < len(self.text):
            c = self.text[self.at]
            if c.isspace() or c == "﻿":
                self.at += 1
            elif self.text.startswith("//", self.at) or self.text.startswith("/*", self.at):
                self._comment()
            else:
                self._step(c)
            if not self.stack and self.out:
                break
        while self.stack:
            self._close(self.stack[-1])
        return "".join(self.out)

    def _comment(self) -> None:
        end = self.text.find("\n" if self.text[self.at + 1] == "/" else "*/", self.at + 2)
        self.at = len(self.text) if end < 0 else end + (1 if self.text[self.at + 1] == "/" else 2)

    def _step(self, c: str) -> None:
        if c in "}]":
            self.at += 1
            opener = "{" if c == "}" else "["
            if opener in self.stack:
                while self.stack[-1] != opener:
                    self._close(self.stack[-1])
                self._close(opener)
        elif c == ",":
            self.at += 1
            if self.state == "colon":
                self._put(":null,")
                self.state = "key"
            elif self.state == "value" and self.stack[-1] == "{":
                self._put("null,")
                self.state = "key"
            elif self.state == "comma":
                self._put(",")
                self.state = "key" if self.stack[-1] == "{" else "value"
        elif c == ":":
            self.at += 1
            if self.state == "colon":
                self._put(":")
                self.state = "value"
        else:
            if self.state == "comma":
                self._put(",")
                self.state = "key" if self.stack[-1] == "{" else "value"
            if self.state == "colon":
                self._put(":")
                self.state = "value"
            if self.state == "key":
                self._put(self._string(c) if c in _QUOTES else json.dumps(self._bare(":{}[],\"'"), ensure_ascii=False))
                self.state = "colon"
            elif c in "{[":
                self.at += 1
                self.stack.append(c)
                self._put(c)
                self.state = "key" if c == "{" else "value"
            else:
                self._put(self._string(c) if c in _QUOTES else self._scalar())
                self.state = "comma"

    def _put(self, piece: str) -> None:
        self.out.append(piece)

    def _close(self, opener: str) -> None:
        """Closes the innermost bracket, which is `opener`: what it still lacks is set, a comma before its end goes."""
        if self.state == "colon":
            self._put(":null")
        elif self.state == "value" and self.out[-1] == ":":
            self._put("null")
        elif self.out[-1].endswith(",") and self.state in ("key", "value"):
            self.out[-1] = self.out[-1][:-1]
        self.stack.pop()
        self._put("}" if opener == "{" else "]")
        self.state = "comma"

    def _string(self, quote: str) -> str:
        """A string from its opening quote on, with double quotes and all that must be escaped escaped."""
        end, parts, text = _QUOTES[quote], [], self.text
        self.at += 1
        while self.at < len(text):
            c = text[self.at]
            if c == end:
                self.at += 1
                return '"' + "".join(parts) + '"'
            if c == "\\":
                following = text[self.at + 1 : self.at + 2]
                if not following:
                    parts.append("\\\\")
                    self.at += 1
                elif following == "u":
                    digits = _HEX.match(text, self.at + 2, self.at + 6)[0]
                    cut = self.at + 2 + len(digits) == len(text)
                    parts.append(f"\\u{digits}" + "0" * (4 - len(digits)) if len(digits) == 4 or cut else "\\\\u" + digits)
                    self.at += 2 + len(digits)
                elif following in "\"\\/bfnrt'":
                    parts.append(following if following == "'" else "\\" + following)
                    self.at += 2
                else:
                    parts.append("\\\\")
                    self.at += 1
            else:
                parts.append('\\"' if c == '"' else json.dumps(c)[1:-1] if c < " " else c)
                self.at += 1
        return '"' + "".join(parts) + '"'

    def _bare(self, stops: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops and self.text[self.at] not in "\r\n":
            self.at += 1
        if self.at == start:
            self.at += 1
        return self.text[start : self.at].strip()

    def _scalar(self) -> str:
        """A number, a literal or a bare word; at the end of the text a part of a literal or number is completed."""
        text, start = self.text, self.at
        number = _NUMBER.match(text, start)
        after = text[number.end() : number.end() + 1] if number else "x"
        if number and number[0] and (not after or after in ",]}" or after.isspace()):
            self.at = number.end()
            return number[0]
        word = self._bare(",]}")
        if word in _WORDS:
            return _WORDS[word]
        if self.at >= len(text):
            for full in ("true", "false", "null"):
                if full.startswith(word):
                    return full
            if word and _NUMBER.fullmatch(word + "0"):
                return word + "0"
        return json.dumps(word, ensure_ascii=False)


def repair(text: str | None) -> str | None:
    """A text's first object or array as valid JSON; null without one."""
    return Repair(text).run() if text else None


@F.pandas_udf(StringType())
def _repaired(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(repair, na_action="ignore")


def bare_json(text: Column) -> Column:
    """A text without a code fence around it and white space at its ends."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    inner = F.regexp_extract(trimmed, r"(?s)^```(?:json)?\s*(.*?)\s*(?:```)?$", 1)
    return F.when(trimmed.startswith("```"), inner).otherwise(trimmed)


def repaired(text: Column) -> Column:
    """A text as JSON: itself if it parses, which Spark decides, else as `repair` makes it; null if nothing can be made of it. Only texts that don't parse reach Python."""
    bare = bare_json(text)
    whole = F.try_parse_json(bare).isNotNull() & bare.rlike(r"^[\{\[]")
    return F.when(whole, bare).otherwise(_repaired(F.when(~whole, bare)))


def _unescaped(text: Column) -> Column:
    r"""\n, \", \\ and \/ undone, \r and \t taken out."""
    out = F.regexp_replace(text, r"\\[rt]", "")
    return F.regexp_replace(F.replace(out, F.lit("\\n"), F.lit("\n")), r'\\(["\\/])', "$1")


def _segment(text: Column, key: str, keys: Sequence[str]) -> Column:
    """What stands behind a key up to the next of the other keys, or the end."""
    mark = lambda k: rf"""["']?{k}["']?\s*:"""
    start = F.regexp_instr(text, F.lit(mark(key)))
    after = F.when(start > 0, F.regexp_replace(F.substring(text, start, F.length(text)), rf"^{mark(key)}", ""))
    others = [k for k in keys if k != key]
    return bound(after, lambda a: F.split(a, "|".join(map(mark, others)), 2)[0]) if others else after


def salvaged(text: Column, key: str, keys: Sequence[str], strings: Sequence[str], lists: Sequence[str]) -> Column:
    """The fields that can be read of the object under a key though it is cut: JSON of the strings and lists that are whole; null if all are empty."""
    found = _segment(text, key, keys)

    def made(segment: Column) -> Column:
        named = lambda f: rf"""["']?{f}["']?\s*:\s*"""
        one = {f: F.nullif(F.regexp_extract(segment, named(f) + r'"((?:[^"\\]|\\.)*)"', 1), F.lit("")) for f in strings}
        many = {f: F.filter(F.transform(F.regexp_extract_all(F.regexp_extract(segment, named(f) + r"\[([\s\S]*?)\]", 1), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), _unescaped), lambda x: x != "") for f in lists}
        empty = F.lit(True)
        for c in one.values():
            empty = empty & c.isNull()
        for c in many.values():
            empty = empty & (F.size(c) == 0)
        return F.when(segment.isNotNull() & ~empty, F.to_json(F.struct(*[F.coalesce(_unescaped(c), F.lit("")).alias(f) for f, c in one.items()], *[c.alias(f) for f, c in many.items()])))

    return bound(found, made)


def loose_object(text: Column, keys: Sequence[str], strings: Sequence[str], lists: Sequence[str]) -> Column:
    """Map of key to JSON of the objects that a damaged answer holds under some keys; null if it holds none.

    First the whole answer, as it is or repaired, if it has one of the keys; else for each key its balanced block, as it
    is or repaired; else its fields one by one.
    """

    def made(t: Column) -> Column:
        whole = repaired(t)
        has = [F.get_json_object(whole, f"$.{k}") for k in keys]
        by_key = []
        for k in keys:
            start = F.regexp_instr(t, F.lit(rf"""["']?{k}["']?\s*:\s*\{{"""))
            block = balanced_block(F.when(start > 0, F.regexp_replace(F.substring(t, start, F.length(t)), rf"""^["']?{k}["']?\s*:\s*""", "")))
            by_key.append(F.coalesce(F.when(F.try_parse_json(block).isNotNull(), block), salvaged(t, k, keys, strings, lists)))
        any_key = F.coalesce(*has).isNotNull()
        values = [F.when(any_key, a).otherwise(b) for a, b in zip(has, by_key, strict=True)]
        pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in zip(keys, values, strict=True))), lambda p: p["value"].isNotNull())
        return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))

    return made(bare_json(text))
