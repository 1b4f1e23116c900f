"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming decoder."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.llm.common import held_alone, small_batches

#: Pieces, pairs of tokens (and steps of the decoder) and states that a worker keeps, about 150 MB in all, before it starts
#: pieces, pairs and steps anew; and states beyond those kept after which it starts the states anew. Results don't depend on it.
PIECES, PAIRS, STATES, MISSED = 200_000, 200_000, 60_000, 5_000_000
#: Rows of a batch whose ids a worker holds at once.
ROWS = 256
#: Letters of texts that the standard library's regex splits as the Unicode one does, only faster.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[\\x00-\\x1b\\x20-\\x7f{_LATIN}]*")
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\\s0-9{_LATIN}]+|\\s+(?!\\S)|\\s+")
#: The pattern that _FAST stands in for.
_DEFAULT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Function that lists a text's matches of the pattern."""
    full = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    if pattern != _DEFAULT:
        return full.findall
    return lambda text: _FAST.findall(text) if _PLAIN.fullmatch(text) else full.findall(text)


class Transducer:
    """Bytes in, token ids out, the same ids as merging the lowest-ranked neighbours again and again.

    A sequence of tokens is the encoding of its bytes just if every two neighbours are the encoding of theirs,
    so a nondeterministic machine guesses token ends and checks each new token against the one before.
    A state here is the set of its live guesses, each a last token and a node in the tree of all tokens' bytes;
    guesses that no longer token goes on with are dropped. What a state puts out is the token that ends the
    encoding of the bytes so far, and going back from token to token gives the whole encoding. Transitions are
    made when they are first needed and kept.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.below: dict[int, int] = {}  # by node and next byte
        self.token, self.grows = [-1], [True]
        for raw, token in ranks.items():
            node = 0
            for byte in raw:
                self.grows[node] = True
                if (after := self.below.get(node << 8 | byte)) is None:
                    after = self.below[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
                node = after
            self.token[node] = token
        self.spines: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [(-1, 0)]  # last token and node of each guess, by the place where the guess begins
        self.number = {self.states[0]: 0}
        self.moves: dict[int, int] = {}  # by state and next byte
        self.ends: list[int] = [-1]
        self.spare, self.missed = 0, 0

    def _spine(self, token: int) -> tuple[list, list]:
        """Parts of a token at its left and right edge, outermost last, each with the rank of the part that takes it up."""
        if token not in self.spines:
            raw = self.bytes[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            never = 1 << 60
            left, right = [[parts[0], never]], [[parts[-1], never]]
            while len(parts) > 1:
                best, at = min((self.ranks.get(a + b, never), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == never:  # merging never makes this token
                    self.spines[token] = ([], [])
                    return self.spines[token]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    left[-1][1] = best
                    left.append([parts[0], never])
                if at == len(parts) - 1:
                    right[-1][1] = best
                    right.append([parts[-1], never])
            self.spines[token] = (left, right)
        return self.spines[token]

    def joins(self, one: int, two: int) -> bool:
        """Whether merging leaves the boundary between the two tokens alone: no part that ends one and no part that begins two merge while both still stand."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
            self.spines.clear()
        fit = self.pairs[one << 32 | two] = self._fit(one, two)
        return fit

    def _fit(self, one: int, two: int) -> bool:
        left = self._spine(two)[0]
        if one < 0 or not left:
            return bool(left)
        get = self.ranks.get
        for a, up_a in self._spine(one)[1]:
            for b, up_b in left:
                rank = get(a + b)
                if rank is not None and rank < up_a and rank <= up_b:
                    return False
        return True

    def _move(self, state: int, byte: int) -> int:
        after, whole, guesses, below, pairs = [], -1, iter(self.states[state]), self.below, self.pairs
        for last, node in zip(guesses, guesses, strict=True):  # by the place where their last token begins, so equal sets have equal order
            node = below.get(node << 8 | byte)
            if node is None:
                continue
            if self.grows[node]:
                after += last, node
            if whole < 0 and (token := self.token[node]) >= 0:
                fit = pairs.get(last << 32 | token)
                if self.joins(last, token) if fit is None else fit:
                    whole = token  # just one guess can end here
        key = (*after, whole, 0)
        number = self.number.get(key)
        if number is None:
            if len(self.states) >= STATES + 2:  # it takes the place of the last but one such state
                self.spare, self.missed = 1 - self.spare, self.missed + 1
                number = len(self.states) - 1 - self.spare
                self.states[number], self.ends[number] = key, whole
                return number
            number = len(self.states)
            self.states.append(key)
            self.ends.append(whole)
            if number >= STATES:
                return number
            self.number[key] = number
        if state < STATES:
            self.moves[state << 8 | byte] = number
        return number

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if self.missed > MISSED:
            self.clear()
        state, found, moves, ends = 0, [], self.moves, self.ends
        for byte in piece:
            state = moves.get(state << 8 | byte) or self._move(state, byte)  # none leads back to the first
            found.append(ends[state])
        out, at = [], len(found)
        while at:
            token = found[at - 1]
            out.append(token)
            at -= self.size[token]
        return tuple(out[::-1])


class Utf8Stream:
    """Incremental UTF-8: bytes come in as tokens, whole characters go out; what is no UTF-8 goes out as it is.

    The state is the begun character, at most three bytes; steps are kept by state and token.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.steps: dict[bytes, dict[int, tuple[bytes, bytes]]] = {b"": {}}
        self.kept = 0
        self.alone = {token: raw for token, raw in tokens.items() if not self._open(raw)}  # tokens that begin no character which they don't end

    @staticmethod
    def _open(raw: bytes) -> int:
        """Bytes at the end that begin a character and lack its rest."""
        for back in range(1, min(3, len(raw)) + 1):
            lead = raw[-back]
            if lead >= 0xC0:
                need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
                return back if back < need else 0
            if lead < 0x80:
                break
        return 0

    def _step(self, held: bytes, token: int) -> tuple[bytes, bytes]:
        raw = held + self.tokens[token]
        left = self._open(raw)
        rest = raw[len(raw) - left :]
        if self.kept >= PAIRS:
            self.kept = 0
            for known in self.steps.values():
                known.clear()
        self.kept += 1
        self.steps.setdefault(rest, {})
        self.steps[held][token] = rest, raw[: len(raw) - left]
        return self.steps[held][token]

    def feed(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Bytes of whole characters, as soon as each is complete; at the end what an unfinished one has."""
        held, steps = b"", self.steps
        for token in ids:
            held, out = steps[held].get(token) or self._step(held, token)
            yield out
        if held:
            yield held


    def spans(self, ids: Iterable[int]) -> Iterator[bytes]:
        """What feed() gives, a run of tokens of whole characters at a time."""
        ids = list(ids)
        whole = list(map(self.alone.get, ids))
        at = 0
        while at < len(ids):
            try:
                end = whole.index(None, at)
            except ValueError:
                end = len(ids)
            if end > at:
                yield b"".join(whole[at:end])
            at = end
            held = b""
            while at < len(ids):
                held, out = self.steps[held].get(ids[at]) or self._step(held, ids[at])
                at += 1
                yield out
                if not held:
                    break
            yield held


class Codec:
    """Encoder and decoder of one vocabulary, with the pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = splitter(pattern)
        self.transducer = Transducer(ranks)
        self.stream = Utf8Stream(self.transducer.bytes)
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}  # those known when the last half of PIECES was full; what comes again stays

    def _piece(self, piece: str) -> tuple[int, ...]:
        if len(self.known) > PIECES // 2:
            self.known, self.before = {}, self.known
        ids = self.before.get(piece) or self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) < 64:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, make = self.known.get, self._piece
        return list(chain.from_iterable([get(p) or make(p) for p in self.split(text)]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.stream.spans(ids))


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def codec(raw: bytes, pattern: str) -> Codec:
    """The codec of a rank file's content, one for each worker."""
    return held_alone(("codec", hashlib.sha256(raw).hexdigest(), pattern), lambda: Codec(parse_ranks(raw), pattern))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids themselves) of every row's whole text.

    Null and empty texts have no tokens; their digests are those of the empty string. Rows are independent:
    repeated rows repeat, other columns are ignored, an empty table gives an empty result. The rank file
    is read once on the driver and goes to the workers with the function, so executors need no copy of it.
    """
    small_batches(docs.sparkSession)
    with open(ranks_path, "rb") as file:
        raw = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        names = [str(i) for i in range(max(own.transducer.bytes) + 1)]
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            counts, firsts, seconds, lists = [], [], [], []
            for value in batch.column(1):
                ids = own.encode(value.as_py() or "")
                counts.append(len(ids))
                firsts.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                seconds.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(firsts, pa.string()), pa.array(seconds, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
