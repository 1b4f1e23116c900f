"""A forgiving HTML tokenizer: a state machine that moves from one significant character to the next."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Elements whose content is no markup, and those that never have any.
RAW_TEXT = frozenset({"script", "style", "textarea", "title", "xmp"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>=]+")
_BARE = re.compile(r"[^\s>]*")


def tokens(html: str) -> Iterator[tuple[str, str, dict]]:
    """(kind, value, attributes): text, open and close tags, in order.

    States are text, tag, attributes, comment and raw text. Nothing fails: a < that starts no tag is text, a comment,
    declaration or tag that doesn't end takes in the rest, names are lower-cased, the first of equal attributes
    counts, entities stay as they are written. Nesting is left to the caller.
    """
    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            yield "text", html[at:], {}
            return
        if start > at:
            yield "text", html[at:start], {}
        at = start + 1
        if html.startswith("!--", at):
            end = html.find("-->", at + 3)
            at = size if end < 0 else end + 3
            continue
        if html[at : at + 1] in ("!", "?"):
            end = html.find(">", at)
            at = size if end < 0 else end + 1
            continue
        closing = html.startswith("/", at)
        name = _NAME.match(html, at + closing)
        if not name:
            yield "text", "<", {}
            continue
        tag, at = name[0].lower(), name.end()
        attributes, at = _attributes(html, at)
        if at is None:
            return
        yield ("close" if closing else "open"), tag, attributes
        if not closing and tag in RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else size
            if stop > at:
                yield "text", html[at:stop], {}
            at = stop


def _attributes(html: str, at: int) -> tuple[dict, int | None]:
    """Attributes from a place within a tag, and the place behind its >; None if it doesn't end."""
    out: dict[str, str] = {}
    size = len(html)
    while True:
        at = _SPACE.match(html, at).end()
        if at >= size:
            return out, None
        if html[at] == ">":
            return out, at + 1
        key = _KEY.match(html, at)
        if not key:  # a stray =
            at += 1
            continue
        at, value = key.end(), ""
        after = at + len(html[at:]) - len(html[at:].lstrip()) if html[at : at + 1].isspace() else at
        if html.startswith("=", after):
            at = after + 1
            while html[at : at + 1].isspace():
                at += 1
            quote = html[at : at + 1]
            if quote in ('"', "'") and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return out, None
                value, at = html[at + 1 : end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        out.setdefault(key[0].lower(), value)


def links(html: str, within: str | None = None) -> Iterator[tuple[dict, str, bool, list[tuple[str, str]]]]:
    """attributes, text, whether the text is unbroken by tags, and the (tag, text) of the elements that follow before the next link or the end of `within`, of each a element.

    A link that isn't closed ends where the next begins, or where the element around it ends; `within` asks for
    an open element of that name around it. An end tag closes up to the nearest element of its name and is
    skipped if there is none.
    """
    stack: list[str] = []
    now: list | None = None  # attributes, text, unbroken, followers, still open, depth

    def finished(found):
        return found[0], "".join(found[1]), found[2], [(tag, "".join(parts)) for tag, parts in found[3]]

    for kind, value, attributes in tokens(html):
        if kind == "text":
            if now and now[4]:
                now[1].append(value)
            elif now and now[3] and now[3][-1][0] == stack[-1:][0] if stack else False:
                now[3][-1][1].append(value)
        elif kind == "open":
            if value == "a":
                if now:
                    yield finished(now)
                    if now[4] and "a" in stack:
                        del stack[len(stack) - 1 - stack[::-1].index("a") :]
                now = [attributes, [], True, [], True, len(stack)] if within is None or within in stack else None
            elif now and now[4]:
                now[2] = False
            elif now:
                now[3].append((value, []))
            if value not in VOID:
                stack.append(value)
        elif value in stack:
            place = len(stack) - 1 - stack[::-1].index(value)
            del stack[place:]
            if now and now[4] and place <= now[5]:
                now[4] = False
            if now and not now[4] and place < now[5] and (within is None or value == within):
                yield finished(now)
                now = None
        elif now and now[4]:
            now[2] = False
    if now:
        yield finished(now)
