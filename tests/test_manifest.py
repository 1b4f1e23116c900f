import os
import threading

import pytest
from pyspark.sql import functions as F

from feedmill.sources import manifest, sinks

FIELDS = "key string, field string, value string"


def fields(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def stored(spark, path):
    return {r.key: r.fields for r in manifest.documents(spark, path).collect()}


def test_fields_of_others_stay(spark, tmp_path):
    path = str(tmp_path / "store")
    manifest.set_fields(fields(spark, [("d1", "executive", '{"a": 1}'), ("d2", "executive", "{}")]), path)
    manifest.set_fields(fields(spark, [("d1", "recap", "[1]"), (None, "x", "1"), ("d3", None, "1"), ("d4", "b", "1"), ("d4", "b", "2")]), path)
    manifest.set_fields(fields(spark, [("d1", "executive", '{"a": 2}'), ("d2", "executive", None)]), path)
    assert stored(spark, path) == {"d1": {"executive": '{"a": 2}', "recap": "[1]"}, "d4": {"b": "2"}}
    assert manifest.latest(path).number == 3


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "store"), []

    def writer(name):
        try:
            for turn in range(4):
                manifest.set_fields(fields(spark, [("doc", f"{name}-{turn}", f"{turn}"), ("doc", name, f"{turn}")]), path)
        except Exception as wrong:
            failed.append(wrong)

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("one", "two", "three")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and manifest.latest(path).number == 12
    assert stored(spark, path) == {"doc": {f"{n}-{t}": f"{t}" for n in ("one", "two", "three") for t in range(4)} | {n: "3" for n in ("one", "two", "three")}}


def test_swaps_of_many_threads_take_each_number_once(tmp_path):
    path, numbers = str(tmp_path), []

    def swap(name):
        for turn in range(20):
            numbers.append(manifest.commit(path, lambda base: ([*base.files, (f"{name}-{turn}", base.number + 1)], "x int")))  # noqa: B023

    threads = [threading.Thread(target=swap, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    last = manifest.latest(path)
    assert sorted(numbers) == list(range(1, 121)) and len(last.files) == 120 and {v for _, v in last.files} == set(numbers)
    assert not [f for f in os.listdir(tmp_path / "_versions") if f.startswith(".")]


def test_a_writer_that_dies_leaves_no_trace_in_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    manifest.write(spark.range(5).withColumn("x", F.lit("a")), path)
    bad = spark.range(100).repartition(4).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise("b"))
    with pytest.raises(Exception, match="lost"):
        manifest.write(bad, path)
    assert manifest.read(spark, path).count() == 5 and manifest.latest(path).number == 1
    whole = manifest.Writer(path, "`id` bigint, `x` string", False)  # killed between its files and its commit
    whole.write(iter(spark.range(3).withColumn("x", F.lit("c")).toArrow().to_batches()))
    assert manifest.read(spark, path).count() == 5
    assert not manifest.vacuum(path)  # young files may be a running writer's
    manifest.vacuum(path, older_than_s=-1)
    assert len(os.listdir(tmp_path / "t" / "data")) == len(manifest.latest(path).files)
    assert manifest.read(spark, path).count() == 5


def test_overwriting_what_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(10), path)
    reader = sinks.current(spark, path)
    for _ in range(3):
        sinks.replace(sinks.current(spark, path).where("id % 2 = 0").withColumn("id", F.col("id") / 2).select(F.col("id").cast("long")), path)
    assert sorted(r.id for r in sinks.current(spark, path).collect()) == [0, 1]
    assert reader.count() == 10  # a reader keeps the version that it began with
    sinks.replace(spark.range(0).withColumn("y", F.lit(1)), path)
    assert sinks.current(spark, path).columns == ["id", "y"] and sinks.current(spark, path).count() == 0


def test_appending_other_columns_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    manifest.write(spark.range(3), path)
    with pytest.raises(Exception, match="has columns"):
        manifest.write(spark.range(3).withColumn("y", F.lit(1)), path)
    assert manifest.read(spark, path).count() == 3


def test_compaction_keeps_what_others_commit_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    for turn in range(5):
        manifest.set_fields(fields(spark, [("d", "f", str(turn)), (f"k{turn}", "g", "1")]), path)
    plain = manifest.commit

    def late(where, change, tries=100):
        if where == path and not getattr(late, "done", False):
            late.done = True
            manifest.set_fields(fields(spark, [("d", "f", "newest"), ("other", "h", "2")]), path)
        return plain(where, change, tries)

    monkeypatch.setattr(manifest, "commit", late)
    manifest.compact(spark, path)
    assert stored(spark, path) == {"d": {"f": "newest"}, "other": {"h": "2"}} | {f"k{t}": {"g": "1"} for t in range(5)}
    assert len({v for _, v in manifest.latest(path).files}) == 2


def test_stores_need_a_mounted_folder(spark, tmp_path):
    with pytest.raises(ValueError, match="mounted"):
        manifest.latest("s3://bucket/x")
    with pytest.raises(FileNotFoundError):
        manifest.read(spark, str(tmp_path / "none"))
