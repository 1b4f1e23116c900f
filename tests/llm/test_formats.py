import base64
import gzip
import hashlib
import json
import random

import public_tokenizers
import pytest
import tiktoken

from feedmill.llm import bpe, chat, decontaminate, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as file:
        raw = file.read()
    return bpe.Codec(bpe.parse_ranks(raw), public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(raw), special_tokens={})


def test_encoding_matches_the_library(codec):
    own, library = codec
    rng = random.Random(1)
    pieces = ["a", "the", " ", "  ", "\n", "é", "ß", "日本", "½", "😀", "'s", "'ll", "1", "23", "!", "\x1c", " ", "\x85", "ing", "\t", "ſ", "Ⅷ", "er", "<|endoftext|>", "é", " "]
    for turn in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) if turn % 3 else "".join(chr(rng.choice([rng.randint(1, 127), rng.randint(0x80, 0x2FF), rng.randint(0x300, 0xD000)])) for _ in range(12))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_caches_start_anew_without_a_change(codec, monkeypatch):
    for name in ("PIECES", "PAIRS", "STATES", "MISSED"):
        monkeypatch.setattr(bpe, name, 20)
    own, library = codec
    for n in range(200):
        text = f"unusual{n}words andpieces{n * 7}"
        assert own.encode(text) == library.encode_ordinary(text)


def test_pieces_that_come_again_are_encoded_once(codec, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 40)
    own, library = bpe.Codec(codec[0].transducer.ranks, public_tokenizers.PATTERN), codec[1]
    made, encode = [], own.transducer.encode
    own.transducer.encode = lambda raw: made.append(raw) or encode(raw)
    for n in range(300):
        text = f" zzqxword unusual{'abcdefghij'[n % 10] * (n // 10 + 1)}x"
        assert own.encode(text) == library.encode_ordinary(text)
    assert made.count(b" zzqxword") == 1
    assert len(own.known) + len(own.before) <= 44


def test_states_hold_no_finished_guess(codec):
    own = bpe.Transducer(codec[0].transducer.ranks)
    for n in range(3000):
        own.encode(f" re{n:b}thation".replace("0", "ing").replace("1", "able").encode())
    assert all(own.grows[node] for state in own.states for node in state[1::2])


def test_spans_of_tokens_are_what_the_stream_gives():
    stream, rng = bpe.Utf8Stream({i: bytes([i]) for i in range(256)} | {256: "é".encode() + b"\xf0\x9f", 257: b"\x98\x80ab", 258: b"plain"}), random.Random(3)
    for _ in range(2000):
        ids = [rng.choice((65, 195, 169, 226, 130, 256, 257, 258, 258, 255)) for _ in range(rng.randint(0, 12))]
        assert b"".join(stream.spans(ids)) == b"".join(stream.feed(ids)) == b"".join(stream.tokens[i] for i in ids)


def test_stream_gives_whole_characters():
    stream = bpe.Utf8Stream({i: bytes([i]) for i in range(256)})
    for text in ("aé日😀z", "߿ࠀ￿"):
        out = [b for b in stream.feed(text.encode()) if b]
        assert out == [c.encode() for c in text]
    for raw in (b"\xff\xc3\x28\xe2\x82", b"\xf0\x9f\x98", b"\x80\x80"):
        assert b"".join(stream.feed(raw)) == raw


def test_round_trip_rows(spark, codec):
    texts = [None, "", "Hello  world\n", "x" * 20_000, "é" * 3000]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(2, texts[2], "z"), (None, "a", "b")]
    out = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(out) == len(rows)
    for r in out:
        text = ("a" if r.doc_id is None else texts[r.doc_id]) or ""
        ids = codec[1].encode_ordinary(text)
        assert (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == (len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_leaks(docs, items, k=5, least=0.8):
    import re
    from collections import Counter

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])
    out = {}
    for doc, text in docs:
        w = words(text)
        for item, passage in items:
            p = words(passage)
            if not p:
                continue
            g = grams(p)
            for start in range(max(1, len(w) - len(p) + 1)):
                h = grams(w[start : start + len(p)])
                common, both = (g & h).total(), (g | h).total()
                if common and common / both >= least and (doc, item) not in out or (doc, item) in out and common / both > out[doc, item][1]:
                    out[doc, item] = (start, common / both)
    return {(d, i, s, round(x, 6)) for (d, i), (s, x) in out.items()}


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize()) for i, n in enumerate((14, 30, 50, 59, 5, 3))] + [(90, None), (91, ""), (92, "one two")]
    docs = []
    for i, (_, passage) in enumerate(items[:6]):
        fill = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(2)]
        docs.append((i, f"{fill[0]} {passage}! {fill[1]}"))
        w = passage.split()
        docs.append((i + 20, f"{fill[0]} {' '.join(w[1:])} {fill[1]}"))
        docs.append((i + 40, f"{fill[0]} {' '.join(w[: len(w) // 2] + ['other'] + w[len(w) // 2 + 1 :])} {fill[1]}"))
    docs += [(70, None), (71, ""), (72, items[1][1]), (73, "ONE, two"), (74, " ".join(vocabulary))]
    schema = "{}_id long, text string, {} string"
    rows = [(d, t, "x") for d, t in docs]
    out = decontaminate.leaks(spark.createDataFrame(rows + rows[:3], schema.format("doc", "item_id")), spark.createDataFrame([(i, t, "y") for i, t in items], schema.format("item", "doc_id"))).collect()
    assert len(out) == len({(r.doc_id, r.item_id) for r in out})
    assert {(r.doc_id, r.item_id, r.start, round(r.similarity, 6)) for r in out} == brute_leaks(docs, items)


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(docs, items).count() == 1


def test_decontamination_and_chat_stay_native(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    turns = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    for frame in (decontaminate.leaks(docs, items), chat.canonical(turns)):
        assert "Python" not in frame._jdf.queryExecution().toString() and "Arrow" not in frame._jdf.queryExecution().toString()


def test_chat_links_orders_and_validates(spark):
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    rows = [
        (1, 0, "user", 'say "x"\n'), (1, 1, "assistant", call(("b", "calculate", '{"precision": 2, "expression": "$call:a"}'), ("a", "search", {"query": "q", "limit": 3}))), (1, 2, "tool", '{"tool_call_id": "b", "content": "7"}'),
        (1, 3, "tool", '{"tool_call_id": "a", "content": "r"}'), (1, 4, "tool", '{"tool_call_id": "zz"}'), (1, 5, "assistant", call(("c", "search", {"limit": 1}), ("d", "search", {"query": 5}), ("e", "unknown", {}), ("f", "search", "no json"))),
        (1, 6, "assistant", "{bad"), (1, 7, "assistant", call(("g", "search", {"query": "$call:h"}), ("h", "search", {"query": "$call:g"}))), (2, 0, None, None), (2, 1, "tool", '{"tool_call_id": "a", "content": "other"}'), (None, 0, "tool", '{"tool_call_id": "a"}'),
    ]
    out = chat.canonical(spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, json string")).collect()
    calls = {(r.conv_id, r.call_id): r for r in out if r.kind == "call"}
    assert {k[1]: (r.linked, r.valid) for k, r in calls.items()} == {"a": (True, True), "b": (True, True), "c": (False, False), "d": (False, False), "e": (False, False), "f": (False, False), "g": (False, False), "h": (False, False)}
    results = {(r.conv_id, r.call_id): r.linked for r in out if r.kind == "result"}
    assert results == {(1, "a"): True, (1, "b"): True, (1, "zz"): False, (2, "a"): False, (None, "a"): False}
    order = [r.call_id for r in sorted((r for r in out if r.conv_id == 1 and r.call_id in ("a", "b")), key=lambda r: (r.after, r.level, r.kind == "result", r.turn, r.part))]
    assert order == ["a", "a", "b", "b"]
    assert calls[1, "a"].json == '{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search","type":"call"}'
    for r in out:
        value = json.loads(r.json)
        assert r.json == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert chat.canonical(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_archives_round_trip(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/\r\nc", None), (4, "u", ""), (5, "é", "ünï\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "v", "z" * 100_000), (7, "w", "<p>x</p>")]
    frame = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, record_type string")
    out = {r.page_id: r for r in warc.round_trip(frame).collect()}
    assert len(out) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        top = max(j for j, _, other in pages if (other or "") == (html or ""))
        assert (out[i].payload_bytes, out[i].payload_digest, out[i].record_type, out[i].refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top)
    assert warc.round_trip(frame.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(frame, least_bytes=10**6).collect()} == {"response"}
    assert warc.round_trip(frame.unionByName(frame)).count() == 2 * len(pages)


def archive(spark, n=6):
    rows = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{'text ' * (20 + i)}</p>") for i in range(n)], "page_id long, url string, html string")
    return [r.record.encode() + b"\r\n\r\n" for r in warc.records(rows).collect()]


def test_salvage_of_plain_files(spark):
    recs = archive(spark)
    whole = b"".join(recs)
    assert [x[0] for x in warc.salvage(whole)] == ["record"] * 6
    at = len(recs[0]) + len(recs[1]) - 20  # within the second payload
    damaged = whole[:at] + b"##" + whole[at + 2 :]
    assert [(k, o, n) for k, o, n, *_ in warc.salvage(damaged)][:3] == [("record", 0, len(recs[0])), ("gap", len(recs[0]), len(recs[1])), ("record", len(recs[0]) + len(recs[1]), len(recs[2]))]
    cut = recs[0] + recs[1][:100] + recs[2] + b"junk" + recs[3] + recs[4][:50]
    got = list(warc.salvage(cut))
    assert [x[0] for x in got] == ["record", "gap", "record", "gap", "record", "gap"]
    assert sum(x[2] for x in got) == len(cut) and [x[1] for x in got] == [0, *[sum(y[2] for y in got[:i]) for i in range(1, 6)]]
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"no archive")] == ["gap"]


def test_salvage_of_compressed_files(spark):
    parts = [gzip.compress(r) for r in archive(spark)]
    bad = bytearray(parts[1])
    bad[len(bad) // 2] ^= 255
    data = parts[0] + bytes(bad) + parts[2] + parts[3][:60] + parts[4]
    assert [x[0] for x in warc.salvage(data)] == ["record", "gap", "record", "gap", "record"]


def test_reader_lists_gaps(spark, tmp_path):
    recs = archive(spark)
    (tmp_path / "a.warc").write_bytes(recs[0] + b"lost" + recs[1])
    out = warc.read_archives(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [(r.kind, r.length, r.reason) for r in out] == [("record", len(recs[0]), None), ("gap", 4, "no version line"), ("record", len(recs[1]), None)]
    assert out[0].payload.startswith(b"<p>text")


def record(fields, body=b"x"):
    return b"WARC/1.1\r\n" + fields + b"Content-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_repeated_and_folded_fields_are_valid():
    good = record(b"WARC-Type: metadata\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nX-Long: one\r\n two\r\n\tthree\r\n")
    found = list(warc.salvage(good * 2))
    assert [x[0] for x in found] == ["record", "record"]
    assert found[0][3]["warc-concurrent-to"] == "<a>\n<b>" and found[0][3]["x-long"] == "one two three"
    twice = record(b"WARC-Type: metadata\r\nContent-Length: 9\r\n")
    assert [x[0] for x in warc.salvage(twice + good)] == ["gap", "record"]


def test_large_members_and_many_small_ones():
    rng = random.Random(9)
    big = record(b"WARC-Type: resource\r\n", bytes(rng.randrange(256) for _ in range(300_000)))
    data = b"".join(gzip.compress(x) for x in [big, *[record(b"WARC-Type: metadata\r\n")] * 500, big])
    found = list(warc.salvage(data))
    assert [x[0] for x in found] == ["record"] * 502 and found[-1][1] + found[-1][2] == len(data) and len(found[0][4]) == 300_000


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    monkeypatch.setattr(warc, "CLASSES", (1 << 10, 1 << 15))
    rows = [(i, "http://x", "y" * (50_000 if i % 10 == 0 else 20_000 if i % 3 == 0 else 10)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert max(sizes) <= 100_000
    back = warc.read_archives(spark, f"file://{tmp_path}/w", with_payload=False)
    assert back.where("kind = 'record'").count() == 120 and back.where("kind = 'gap'").count() == 0


SCHEMA = {
    "type": "object",
    "properties": {
        "name": {"type": "string", "minLength": 2, "maxLength": 4},
        "kind": {"enum": ["a", 3, None]},
        "size": {"type": ["number", "null"], "minimum": 0, "maximum": 10},
        "tags": {"type": "array", "items": {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"], "additionalProperties": False}},
    },
    "required": ["name"],
    "additionalProperties": False,
}


def brute_fits(x, s):
    kinds = s.get("type")
    if kinds:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        test = {"string": lambda v: isinstance(v, str), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "null": lambda v: v is None}
        if not any(test[k](x) for k in kinds):
            return False
    if "enum" in s and not any(x == e and type(x) is type(e) for e in s["enum"]):
        return False
    if isinstance(x, int | float) and not isinstance(x, bool) and not s.get("minimum", x) <= x <= s.get("maximum", x):
        return False
    if isinstance(x, str) and not s.get("minLength", 0) <= len(x) <= s.get("maxLength", 99):
        return False
    if isinstance(x, dict):
        for k, rule in s.get("properties", {}).items():
            if k in x and not (x[k] is None and "null" not in rule.get("type", "null")) and not brute_fits(x[k], rule):
                return False
        for k in s.get("required", []):
            if x.get(k) is None and "null" not in (s.get("properties", {}).get(k, {}).get("type") or []):
                return False
        if s.get("additionalProperties") is False and set(x) - set(s.get("properties", {})):
            return False
    return not isinstance(x, list) or "items" not in s or all(brute_fits(e, s["items"]) for e in x)


def test_schemas_match_brute_force(spark):
    rng = random.Random(12)
    value = lambda: rng.choice(["ab", "x", "abcde", 3, -1, 11, 2.5, True, None, [], {}, [{"k": 1}], [{"k": "1"}], [{"k": 1, "z": 2}], [{}], "a"])
    cases = [{k: value() for k in ("name", "kind", "size", "tags", "other") if rng.random() < (0.25 if k == "other" else 0.6)} for _ in range(300)]
    cases = [c | {"name": "abc"} if rng.random() < 0.6 else c for c in cases] + [[], 3]
    turns = [(i, 1, "assistant", json.dumps({"tool_calls": [{"id": "c", "name": "t", "arguments": json.dumps(c)}]})) for i, c in enumerate(cases)]
    out = chat.canonical(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), {"t": SCHEMA}).where("kind = 'call'").collect()
    got = {r.conv_id: r.valid for r in out}
    for i, c in enumerate(cases):
        assert got[i] == (isinstance(c, dict) and brute_fits(c, SCHEMA)), c
    assert {got[i] for i in got} == {True, False}


def test_links_and_order_match_brute_force(spark):
    rng = random.Random(21)
    turns = []
    for conv in range(25):
        ids = [f"c{k}" for k in range(rng.randint(1, 7))]
        turn = 0
        for i in ids + rng.sample(ids, min(2, len(ids))):
            arguments = json.dumps({"query": f"$call:{rng.choice([*ids, 'none'])}"} if rng.random() < 0.7 else {"query": "x"})
            turn += 1
            turns.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": arguments}]})))
            if rng.random() < 0.8:
                turn += 1
                turns.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "odd"]), "content": "r"})))
    rows = chat.canonical(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    for conv in range(25):
        own = [t for t in turns if t[0] == conv]
        calls, answers = {}, {}
        for _, turn, role, text in own:
            body = json.loads(text)
            if role == "tool":
                answers.setdefault(body["tool_call_id"], turn)
            else:
                c = body["tool_calls"][0]
                calls.setdefault(c["id"], (turn, json.loads(c["arguments"])["query"].removeprefix("$call:") if "$call:" in c["arguments"] else None))
        level, after, busy = {}, {}, set()

        def settle(c):
            if c in level or c in busy:
                return c in level
            busy.add(c)
            turn, used = calls[c]
            ok = used not in calls or settle(used)
            if ok:
                after[c], level[c] = turn, 0
                if used in calls:
                    then = max(after[used], answers.get(used, after[used]))
                    after[c], level[c] = max(turn, then), level[used] + 1
            busy.discard(c)
            return ok

        for c in calls:
            settle(c)
        for r in rows:
            if r.conv_id == conv and r.kind == "call":
                assert r.linked == (r.call_id in answers) and r.valid == (r.call_id in level)
                if r.call_id in level:
                    assert (r.level, r.after) == (level[r.call_id], max(r.turn, after[r.call_id]))
            if r.conv_id == conv and r.kind == "result":
                assert r.linked == (r.call_id in calls)


def test_chains_and_cycles_of_calls_in_few_rounds(spark):
    """A chain of 200 calls, wide references, cycles and what leads into them, against a walk over all references."""
    rng = random.Random(13)
    calls = {f"c{i}": (i, [f"c{i - 1}"] * (i > 0)) for i in range(200)}
    calls |= {f"w{i}": (i, rng.sample([f"w{j}" for j in range(i)], min(i, rng.randint(0, 3)))) for i in range(30)}
    calls |= {"x": (5, ["y"]), "y": (6, ["z"]), "z": (7, ["x", "c3"]), "into": (8, ["x", "c9"]), "self": (9, ["self"]), "lost": (3, ["nobody"])}
    answers = {c: turn + rng.randint(0, 40) for c, (turn, _) in calls.items() if rng.random() < 0.6}
    rows = []
    for c, (turn, used) in calls.items():
        arguments = json.dumps({f"a{k}": f"$call:{u}" for k, u in enumerate(used)})
        rows.append((1, turn, "assistant", json.dumps({"content": "", "tool_calls": [{"id": c, "name": "t", "arguments": arguments}]})))
    rows += [(1, turn, "tool", json.dumps({"tool_call_id": c, "content": "ok"})) for c, turn in answers.items()]
    rows += [(2, 4, "assistant", json.dumps({"content": "", "tool_calls": [{"id": "c0", "name": "t", "arguments": json.dumps({"a": "$call:c7"})}]}))]  # ids count within their conversation

    done = {}  # after, level, latest answer; what is never settled ends in a cycle
    while True:
        new = {}
        for c, (turn, used) in calls.items():
            found = [done.get(u) for u in used if u in calls]
            if c not in done and None not in found:
                after = max([turn, *(f[2] for f in found)])
                new[c] = after, max([0, *(f[1] + 1 for f in found)]), max(after, answers.get(c, after))
        if not new:
            break
        done |= new
    want = {c: done[c][:2] if c in done else (turn, 0) for c, (turn, _) in calls.items()}
    got = {r.call_id: (r.after, r.level) for r in chat.canonical(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call' and conv_id = 1").collect()}
    assert got == want and got["c199"][1] == 199
