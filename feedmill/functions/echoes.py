"""Sentences that say again what another text has said: the longest shared run by a suffix automaton, and what may be cut out of a sentence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class SuffixAutomaton:
    """All substrings of a text in states that grow with its length; made a character at a time."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in text:
            now = self._state(self.size[last] + 1, {}, 0)
            at = last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = now
                at = self.link[at]
            if at >= 0:
                to = self.next[at][c]
                if self.size[to] == self.size[at] + 1:
                    self.link[now] = to
                else:
                    copy = self._state(self.size[at] + 1, dict(self.next[to]), self.link[to])
                    while at >= 0 and self.next[at].get(c) == to:
                        self.next[at][c] = copy
                        at = self.link[at]
                    self.link[to] = self.link[now] = copy
            last = now

    def _state(self, size: int, moves: dict[str, int], link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def longest_in(self, text: str) -> tuple[int, int]:
        """Start and length of the first longest run of a text that the automaton's text holds."""
        state = length = 0
        start = best = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            if length > best:
                start, best = i + 1 - length, length
        return start, best


# Signs that are no content, characters of numbers, words that need an object behind them, words that need a subject before them, particles that may not follow a cut.
SIGNS = "，。！？、；：「」『』（）()【】[]·—-_\"'~～…"
NUMBERISH = set("0123456789零一二三四五六七八九十百千万亿点成,.%")
WANTS_OBJECT = tuple("为 把 将 对 向 从 围绕 随着 按 依据 通过 基于".split())
WANTS_SUBJECT = tuple("在 也 都 就 将 会 能 要 正 持续 同步 跟着 同时 以及 并 而 且 进一步 有所 得以 正在 依然 仍然".split())
PARTICLES = "的 了 是 等 与 和 及".split()
COMMAS, STOPS, PEEL = "，,、；;", "。！？", "，。；、"


@dataclass(frozen=True)
class Style:
    """span: content characters of an echo; ratio of a sentence and rest left over at which it goes as a whole; ends: signs that end a sentence; peel: signs at which it may be cut."""

    span: int = 8
    ratio: float = 0.6
    rest: int = 15
    ends: str = "。；"
    peel: str = PEEL


RESULT = "text string, removed_chars long, removed_sentences long, trimmed_sentences long, skipped_numeric long, skipped_struct long, echoes array<string>"


def _content(text: str) -> tuple[str, list[int]]:
    """Characters of content and their places."""
    places = [i for i, c in enumerate(text) if not c.isspace() and c not in SIGNS]
    return "".join([text[i] for i in places]), places


def _tidy(text: str) -> str:
    """No sign left hanging by a cut: commas that meet become one, those beside a stop or at the start go, and so does a particle right behind one."""
    out: list[str] = []
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in COMMAS:
            end += 1
        if end == at:
            out.append(text[at])
            at += 1
            continue
        after = end
        while after < len(text) and text[after].isspace():
            after += 1
        particle = next((p for p in PARTICLES if text.startswith(p, after)), "")
        if not out or out[-1] in STOPS or (end < len(text) and text[end] in STOPS):
            at = end
        elif particle:
            out.append("，")
            at = after + len(particle)
        else:
            out.append(text[at] if end == at + 1 else "，")
            at = end
    return re.sub(r"\s{2,}", " ", "".join(out)).strip()


def _safe(raw: str, start: int, end: int, peel: str) -> bool:
    """Whether a sentence stays one without that part: cut at signs, no preposition left without its object, no verb without its subject."""
    before, after = raw[:start], raw[end:].lstrip()
    if (before and before[-1] not in peel) or (after and after[0] not in peel):
        return False
    edge = COMMAS + STOPS
    return not before.rstrip(edge + " \t\n\r　").endswith(WANTS_OBJECT) and not after.lstrip(edge).startswith(WANTS_SUBJECT)


def pruned(text: str | None, told: str | None, style: Style = Style()) -> tuple:  # noqa: B008
    """RESULT of a text against what was told: sentences that only repeat it go, repeating parts of others are cut where that is safe.

    Time and memory grow with the sum of both lengths.
    """
    text, told = (text or "").strip(), (told or "").strip()
    if not text or not told:
        return text, 0, 0, 0, 0, 0, []
    other = _content(told)[0]
    runs = {other[i : i + style.span] for i in range(len(other) - style.span + 1)}  # a sentence without one of these has no echo, and most have none
    known = None
    kept, echoes, chars, gone, trimmed, numeric, struct = [], [], 0, 0, 0, 0, 0
    for raw in re.split(rf"(?<=[{re.escape(style.ends)}])", text):
        if not raw.strip():
            continue
        content, places = _content(raw)
        if not any(content[i : i + style.span] in runs for i in range(len(content) - style.span + 1)):
            kept.append(raw)
            continue
        known = known or SuffixAutomaton(other)
        at, size = known.longest_in(content)
        echo, start, end = content[at : at + size], places[at], places[at + size - 1] + 1
        if not (size / len(content) >= style.ratio and len(content) - size < style.rest):
            if (at and content[at - 1] in NUMBERISH) or (at + size < len(content) and content[at + size] in NUMBERISH):
                numeric += 1
                kept.append(raw)
                continue
            if not _safe(raw, start, end, style.peel):
                struct += 1
                kept.append(raw)
                continue
            left = _tidy(raw[:start] + raw[end:])
            if len(_content(left)[0]) >= style.span:
                trimmed += 1
                chars += len(raw) - len(left)
                echoes.append(echo)
                kept.append(left)
                continue
        gone += 1
        chars += len(raw)
        echoes.append(echo)
    return (_tidy("".join(kept)) if chars else text), chars, gone, trimmed, numeric, struct, echoes


def without_echoes(text: Column, told: Column, style: Style = Style()) -> Column:  # noqa: B008
    """pruned() as a Column; nulls count as empty."""

    @F.pandas_udf(RESULT)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for own, other in parts:
            yield pd.DataFrame([pruned(a, b, style) for a, b in zip(own, other, strict=True)], columns=[c.split()[0] for c in RESULT.split(", ")])

    return run(text, told)
