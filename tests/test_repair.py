import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from feedmill.functions import echoes, jsonrepair

WHOLE = ['{"k": 69}', '{"a": [1, -2.5e3, true], "b": null}', '{"a": {"b": ["x", ""]}}', '[{"a": "q\\"\\u00e9"}, false]', '{"k": "a,}", "l": {}}', "[[], [[7]]]"]
TOKENS = ['"', ":", "null", "}", "]", "0", "\\", "00", "000", "0000", *{w[i:] for w in ("true", "false", "null") for i in range(1, len(w))}]


def fewest(text):
    """Fewest pieces that make a cut text JSON when they are put behind it, a comma at its end taken off or not; the comma counts as one."""
    starts = [(text, 0)] + ([(text.rstrip()[:-1], 1)] if text.rstrip().endswith(",") else [])
    for n in range(7):
        for start, cost in starts:
            for more in itertools.product(TOKENS, repeat=n - cost) if n >= cost else ():
                try:
                    json.loads(start + "".join(more))
                    return n
                except ValueError:
                    pass
    raise AssertionError(text)


def pieces_added(text, made):
    """How many pieces a repair of a cut text put behind it; white space outside of strings doesn't count."""
    strip = lambda t: "".join(p if i % 2 else "".join(p.split()) for i, p in enumerate(__import__("re").split(r'("(?:[^"\\]|\\.)*"?)', t)))
    bare, full = strip(text), strip(made)
    cost = 0
    if bare.endswith(",") and not full.startswith(bare):
        bare, cost = bare[:-1], 1
    assert full.startswith(bare), (text, made)
    left = full[len(bare) :]
    best = {0: 0}
    for i in range(len(left)):
        for t in TOKENS:
            if i in best and left.startswith(t, i):
                best[i + len(t)] = min(best.get(i + len(t), 99), best[i] + 1)
    return best[len(left)] + cost


@pytest.mark.parametrize("whole", WHOLE)
def test_cut_texts_are_completed_with_the_fewest_pieces(whole):
    for cut in range(1, len(whole) + 1):
        text = whole[:cut]
        made = jsonrepair.repair(text)
        json.loads(made)
        if whole.count("{") + whole.count("[") <= 3:
            assert pieces_added(text, made) == fewest(text), (text, made)
    assert json.loads(jsonrepair.repair(whole)) == json.loads(whole)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("{'k': 69}", {"k": 69}), ('{"k": 69,}', {"k": 69}), ("{k: 69, l: abc def}", {"k": 69, "l": "abc def"}), ('{"a": 1 "b": 2}', {"a": 1, "b": 2}), ('{"a" 1}', {"a": 1}), ("[1 2,,3,]", [1, 2, 3]),
        ("{'a': 'it\\'s \"so\"'}", {"a": 'it\'s "so"'}), ("{“a”: ‘b’}", {"a": "b"}), ('{"a": True, "b": None, "c": NaN}', {"a": True, "b": None, "c": None}), ('{"a": [1, 2}', {"a": [1, 2]}), ('{"a": 1]}', {"a": 1}),
        ('noise {"a": "x\ny"} more', {"a": "x\ny"}), ('{"a": 1, // so\n "b": /* no */ 2}', {"a": 1, "b": 2}), ('{"a":, "b"}', {"a": None, "b": None}), ('{"a": 1}}}', {"a": 1}), ('{"a": 01}', {"a": "01"}), ("{", {}), ("[", []), ('{"u": "\\u12zz\\q"}', {"u": "\\u12zz\\q"}),
    ],
)
def test_damaged_texts(text, value):
    assert json.loads(jsonrepair.repair(text)) == value


def test_nothing_fails_whatever_the_text():
    rng = random.Random(6)
    for _ in range(6000):
        text = "".join(rng.choice('{}[]":,\'\\ \n/*-1.eEtrufalsn u0“”x') for _ in range(rng.randint(0, 25)))
        made = jsonrepair.repair(text)
        assert made is None or isinstance(json.loads(made), dict | list), (text, made)
        if made is None:
            assert not set(text) & set("{[")


def test_objects_of_an_answer(spark):
    keys, strings, lists = ("us", "aShare", "hk"), ("overview", "spoken"), ("sectors",)
    rows = {
        "whole": '```json\n{"us": {"overview": "up"}, "hk": null}\n```',
        "repaired": "{'us': {'overview': 'up', 'sectors': ['a', 'b'",
        "none": "no object here",
        "other": '{"x": 1}',
        "block": '"junk { "us": {"overview": "u}p"} then "hk": {"overview": "cut',
        "fields": 'junk us: "overview": "so\\n\\"x\\"", sectors: ["a", "", "b"] "hk": "spoken": "hk"',
        "null": None,
    }
    frame = spark.createDataFrame(list(rows.items()), "name string, text string")
    got = {r.name: {k: json.loads(v) for k, v in (r.found or {}).items()} for r in frame.select("name", jsonrepair.loose_object(F.col("text"), keys, strings, lists).alias("found")).collect()}
    assert got["whole"] == {"us": {"overview": "up"}}
    assert got["repaired"] == {"us": {"overview": "up", "sectors": ["a", "b"]}}
    assert got["none"] == got["other"] == got["null"] == {}
    assert got["block"]["us"] == {"overview": "u}p"}
    assert got["fields"] == {"us": {"overview": 'so\n"x"', "spoken": "", "sectors": ["a", "b"]}, "hk": {"overview": "", "spoken": "hk", "sectors": []}}


def brute_longest(a, b):
    best = (0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[1]:
                best = (i, k)
    return best


def test_longest_runs_match_brute_force():
    rng = random.Random(9)
    for _ in range(400):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert echoes.SuffixAutomaton(b).longest_in(a) == brute_longest(a, b)


MUST = "央行开展三千亿元逆回购操作，市场流动性保持合理充裕；公募新规为两万五千亿理财资金打开投资工具空间。"


@pytest.mark.parametrize(
    ("text", "left", "counts"),
    [
        ("央行开展三千亿元逆回购操作，利好客户。", "", (1, 0, 0, 0)),  # nearly all of it was told
        ("黄金定价权向亚洲转移，市场流动性保持合理充裕，避险类配置需求同步抬升并带动更多客户咨询。", "黄金定价权向亚洲转移，避险类配置需求同步抬升并带动更多客户咨询。", (0, 1, 0, 0)),
        ("昨日新规为两万五千亿理财资金打开更大的配置通道与客户需求。", "昨日新规为两万五千亿理财资金打开更大的配置通道与客户需求。", (0, 0, 0, 1)),  # cut within words
        ("本地企业客户资金面宽松，市场流动性保持合理充裕，也在带动结算与融资需求的持续增长。", "本地企业客户资金面宽松，市场流动性保持合理充裕，也在带动结算与融资需求的持续增长。", (0, 0, 0, 1)),  # 也 would lose its subject
        ("全市场规模达到八，市场流动性保持合理充裕，三十三点五万亿的存量继续向净值化产品迁移。", "全市场规模达到八，市场流动性保持合理充裕，三十三点五万亿的存量继续向净值化产品迁移。", (0, 0, 1, 0)),  # numbers beside the cut
        ("这是全新的一句话，与之前所说毫无关系。", "这是全新的一句话，与之前所说毫无关系。", (0, 0, 0, 0)),
    ],
)
def test_what_is_cut_and_what_is_kept(text, left, counts):
    got = echoes.pruned(text, MUST)
    assert (got[0], got[2:6]) == (left, counts)


def test_growth_is_linear_on_long_texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    spent = []
    for n in (5_000, 20_000):
        a, b = (" ".join(rng.choice(words) for _ in range(n)) + "。" for _ in range(2))
        start = time.process_time()
        echoes.pruned(a, b)
        spent.append(time.process_time() - start)
    assert spent[1] < 12 * spent[0]  # sixteen times would be its square


def test_echoes_as_a_column(spark):
    rows = [("央行开展三千亿元逆回购操作，利好客户。", MUST), (None, MUST), ("x", None), ("", "")]
    got = spark.createDataFrame(rows, "a string, b string").select(echoes.without_echoes(F.col("a"), F.col("b")).alias("r")).select("r.*").collect()
    assert [r.text for r in got] == ["", "", "x", ""] and got[0].echoes == ["央行开展三千亿元逆回购操作"]


def test_query_over_documents_matches_a_quadratic_search(spark):
    from feedmill.plans.answers import PROSE
    from feedmill.plans.registry import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["pruned_echoes"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {i for i in texts if i - 1 in texts}
    few = [i for i in sorted(got) if len(texts[i]) * len(texts[i - 1]) < 600_000][:25] + [i for i in got if got[i].removed_chars and len(texts[i]) < 3_000][:5]

    class Slow:
        def __init__(self, text):
            self.text = text

        def longest_in(self, text):
            best = (0, 0)
            for i in range(len(text)):  # a longer run alone counts
                while text[i : i + best[1] + 1] in self.text and i + best[1] < len(text):
                    best = (i, best[1] + 1)
            return best

    fast, echoes.SuffixAutomaton = echoes.SuffixAutomaton, Slow
    try:
        for i in few:
            want = echoes.pruned(texts[i], texts[i - 1], PROSE)
            assert tuple(got[i])[2:] == (*want[1:6], len(want[6]))
    finally:
        echoes.SuffixAutomaton = fast
    assert any(r.removed_sentences for r in got.values())
