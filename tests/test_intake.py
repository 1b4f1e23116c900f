import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from feedmill.operators import ingest, relax
from feedmill.streaming import lookup


def loop(rows, target, whole):
    """What a loop over the levels takes of each group."""
    out = set()
    for group in {r[1] for r in rows}:
        taken = []
        for level in range(3):
            if len(taken) >= target:
                break
            taken += [r[0] for r in sorted((r for r in rows if r[1] == group and r[2] == level), key=lambda r: (-r[3], r[0]))]
        out |= set(taken if whole else taken[:target])
    return out


@pytest.mark.parametrize("broadcast", [relax.BROADCAST_GROUPS, 0])
def test_one_pass_equals_the_loop_at_every_target(spark, monkeypatch, broadcast):
    monkeypatch.setattr(relax, "BROADCAST_GROUPS", broadcast)
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([0, 1, 2, 9]), rng.randint(0, 5)) for i in range(60)] + [(100, "d", 9, 1), (101, "e", None, 1)]
    frame = spark.createDataFrame(rows, "id long, g string, level_of int, score int").persist()
    levels = [F.col("level_of") == 0, F.col("level_of") == 1, F.col("level_of") <= 2]
    for target in (0, 1, 2, 3, 5, 8, 13, 30, 100):
        assert {r.id for r in relax.relaxed(frame, levels, ["g"], [F.desc("score"), "id"], target).collect()} == loop(rows, target, False), target
        if broadcast == 0 and target not in (1, 8):
            continue
        assert {r.id for r in relax.relaxed_levels(frame, levels, ["g"], target).collect()} == loop(rows, target, True), target


def test_relaxation_is_one_shuffle_that_few_rows_reach(spark, capsys):
    relax.relaxed(spark.range(100).withColumn("g", F.col("id") % 3), [F.col("id") > 50, F.lit(True)], ["g"], ["id"], 5).explain("formatted")
    plan = capsys.readouterr().out
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("WindowGroupLimit") == 2  # one before the shuffle, one after


EVENT = {"id": "e", "anchors": ["a"], "topicTags": ["t"], "samples": [{"title": "x"}], "kind": "ipo", "peakScore": 61.5, "broadcastCount": 3, "sections": ["risk"], "lastBroadcastAt": "2024-03-05", "firstBroadcastAt": "2024-03-01"}


def test_every_bad_field_is_listed_and_set_right(spark):
    spoiled = {
        "fine": EVENT, "score": {**EVENT, "peakScore": "high"}, "count": {**EVENT, "broadcastCount": 0}, "day": {**EVENT, "lastBroadcastAt": "2024-02-31"}, "days": {**EVENT, "lastBroadcastAt": 5, "firstBroadcastAt": None},
        "lists": {**EVENT, "sections": {"a": 1}, "kind": ["x"]}, "more": {**EVENT, "note": {"deep": [1]}}, "anchors": {**EVENT, "anchors": "a"}, "id": {**EVENT, "id": ""}, "missing": {k: v for k, v in EVENT.items() if k != "samples"}, "number": 5, "none": None, "list": [1],
    }
    stores = spark.createDataFrame([(1, json.dumps(spoiled), "clash"), (2, "no { json", ""), (3, None, ""), (4, "{}", ""), (5, "[1]", "")], "store long, text string, record string").drop("record")
    found = ingest.revived(stores, "text").collect()
    one = {r.key: r for r in found if r.store == 1}
    assert set(one) >= set(spoiled) - {"none"}
    bad = {k: (r.bad, r.reasons) for k, r in one.items()}
    assert bad["fine"] == ([], []) and bad["score"] == (["peakScore"], []) and bad["count"] == (["broadcastCount"], []) and bad["day"] == (["lastBroadcastAt"], []) and bad["days"] == (["lastBroadcastAt"], []) and bad["lists"] == (["kind", "sections"], [])
    assert bad["anchors"] == (["anchors"], ["no anchors"]) and bad["id"] == (["id"], ["no id"]) and bad["missing"] == ([], ["no samples"]) and bad["number"][1] == ["no object"] and bad["list"][1] == ["no object"]
    r = one["score"].record
    assert (r.peakScore, r.broadcastCount, r.kind, r.lastBroadcastAt) == (0.0, 3, "ipo", datetime.date(2024, 3, 5))
    assert one["count"].record.broadcastCount == 1 and one["day"].record.lastBroadcastAt == datetime.date(2024, 3, 1) and one["days"].record.lastBroadcastAt is None
    assert one["lists"].record.sections == [] and one["lists"].record.kind == "generic" and json.loads(one["more"].rescued["note"]) == {"deep": [1]} and one["score"].rescued == {"peakScore": "high"}
    assert {(r.store, r.key): r.reasons for r in found if r.store > 1} == {(2, None): ["no JSON"], (3, None): ["null"], (5, None): ["no object"]}
    frame = ingest.revived(stores, "text")
    assert {r.key for r in ingest.usable(frame).collect()} == {"fine", "score", "count", "day", "days", "lists", "more"}
    assert ingest.quarantined(frame).count() + ingest.usable(frame).count() == len(found)


def test_no_text_crashes_ingestion(spark):
    rng = random.Random(2)
    whole = json.dumps(EVENT)
    texts = [whole[: rng.randint(0, len(whole))] + rng.choice(["", "}", "x"]) for _ in range(60)] + ["".join(rng.choice('{}[]":,\\ 1atn') for _ in range(12)) for _ in range(200)] + [whole + " ", whole + "}", whole + whole]
    found = ingest.ingested(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", ingest.EVENT).collect()
    for r in found:
        try:
            fine = isinstance(json.loads(r.text), dict)
        except ValueError:
            fine = False
        assert fine or r.reasons
        assert (r.record is None) == bool(r.reasons)
    assert ingest.ingested(spark.createDataFrame([], "text string"), "text", ingest.EVENT).count() == 0


def test_failures_are_asked_again_and_successes_never(spark, tmp_path):
    registry = spark.createDataFrame([("r", "home")], lookup.KNOWN)
    asked = []

    def ask(missing, answers):
        codes = [r.code for r in missing.collect()]
        asked.append(sorted(codes))
        return spark.createDataFrame([(c, answers.get(c)) for c in codes if c in answers], lookup.KNOWN)

    path, codes = str(tmp_path / "known"), spark.createDataFrame([("r",), ("a",), ("a",), ("b",), ("c",), (None,), ("",)], "code string")
    turns = [{"a": "A", "b": None}, {"b": "", "c": "C"}, {"b": "B"}, {}]
    for answers in turns:
        out = lookup.resolved(codes, registry, path, lambda missing: ask(missing, answers))  # noqa: B023
        got = sorted((r.code or "", r.province or "") for r in out.collect())
    assert asked == [["a", "b", "c"], ["b", "c"], ["b"], []]
    assert got == [("", ""), ("", ""), ("a", "A"), ("a", "A"), ("b", "B"), ("c", "C"), ("r", "home")]
    assert {r.code for r in lookup.known(spark, path).collect()} == {"a", "b", "c"}
    assert [r.x for r in spark.createDataFrame([("广东",), ("x",), (None,)], "p string").select(lookup.in_province(F.col("p"), "广东").alias("x")).collect()] == [True, False, False]
