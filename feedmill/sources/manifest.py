"""Tables that several writers change at once: data files, and numbered manifests that name those that count.

A commit makes the next manifest by compare-and-swap: the number is taken by creating its file, which only one writer
can. A writer that comes second reads what the first made and tries again, so no change is lost; readers see one whole
version or another. A writer that dies leaves files that no manifest names; `vacuum` deletes them.
"""

from __future__ import annotations

import json
import os
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_VERSION = re.compile(r"(\d{12})\.json")
FIELDS = "key string, field string, value string"


def _folder(path: str) -> str:
    """The folder of a path that driver and executors see in the same place; a manifest's number is taken with a link, which only such folders have."""
    if "://" in path and not path.startswith("file://") or path.startswith("file:") and not path.startswith(("file:/", "file:///")):
        raise ValueError("manifests need a folder with hard links, mounted on driver and executors")
    return re.sub(r"^file:(//)?", "", path).rstrip("/")


@dataclass(frozen=True)
class Version:
    number: int
    files: tuple[tuple[str, int], ...]  # name of each data file and the version that added it
    schema: str


def latest(path: str) -> Version:
    """The newest whole version; number 0 without files if there is none."""
    folder = os.path.join(_folder(path), "_versions")
    numbers = [int(m[1]) for m in map(_VERSION.fullmatch, os.listdir(folder)) if m] if os.path.isdir(folder) else []
    if not numbers:
        return Version(0, (), "")
    with open(os.path.join(folder, f"{max(numbers):012d}.json"), encoding="utf-8") as file:
        raw = json.load(file)
    return Version(max(numbers), tuple(map(tuple, raw["files"])), raw["schema"])


def commit(path: str, change: Callable[[Version], tuple[list[tuple[str, int]], str]], tries: int = 100) -> int:
    """Makes the next version of what change() makes of the newest one, as often as another writer comes first; returns its number."""
    folder = os.path.join(_folder(path), "_versions")
    os.makedirs(folder, exist_ok=True)
    for turn in range(tries):
        base = latest(path)
        files, schema = change(base)
        draft = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as out:
            json.dump({"files": files, "schema": schema, "at": time.time()}, out)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(draft, os.path.join(folder, f"{base.number + 1:012d}.json"))  # fails if another writer took the number
            return base.number + 1
        except FileExistsError:
            time.sleep(0.005 * min(turn, 20))
        finally:
            os.unlink(draft)
    raise TimeoutError(f"{path}: {tries} other writers came first")


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has finished."""

    files: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: str, overwrite: bool):
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, out, name = os.path.join(_folder(self.path), "data"), None, f"{self.job}-{uuid.uuid4().hex}.parquet"
        os.makedirs(folder, exist_ok=True)
        try:
            for batch in iterator:
                if batch.num_rows:
                    out = out or pq.ParquetWriter(os.path.join(folder, name), batch.schema)
                    out.write_batch(batch)
        finally:
            if out:
                out.close()
        return Written([name] if out else [])

    def commit(self, messages: list[Written | None]) -> None:
        made = [name for m in messages if m for name in m.files]

        def change(base: Version) -> tuple[list[tuple[str, int]], str]:
            if base.schema not in ("", self.schema) and not self.overwrite:
                raise ValueError(f"{self.path} has columns {base.schema}")
            return [*(() if self.overwrite else base.files), *((name, base.number + 1) for name in made)], self.schema

        commit(self.path, change)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for name in m.files if m else ():
                os.unlink(os.path.join(_folder(self.path), "data", name))


class Manifest(DataSource):
    """Format "manifest", for writing: append adds files to a table, overwrite puts them in place of all others. `read` reads it with Spark's own Parquet reader."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), overwrite)


_REGISTERED: set[str] = set()
_REGISTERING = threading.Lock()


def register(spark: SparkSession) -> None:
    """Registers the format once in a session, whose writers may be threads: Spark looks for it in the session that is active in the calling one."""
    spark.createDataFrame([], "x int")  # makes this session the active one
    with _REGISTERING:
        session = spark._jsparkSession.sessionUUID()
        if session not in _REGISTERED:
            spark.dataSource.register(Manifest)
            _REGISTERED.add(session)


def write(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One commit of rows. rows may have been read from the same table."""
    register(rows.sparkSession)
    rows.write.format("manifest").mode("overwrite" if overwrite else "append").save(path)


def read(spark: SparkSession, path: str, with_version: bool = False) -> DataFrame:
    """Rows of the newest version; with _version, the commit that added each, if asked. A table that was never written raises."""
    now = latest(path)
    if not now.number:
        raise FileNotFoundError(f"{path} has no version")
    files = [f"file://{_folder(path)}/data/{name}" for name, _ in now.files]
    out = spark.read.schema(now.schema).parquet(*files) if files else spark.createDataFrame([], now.schema)
    if not with_version:
        return out
    added = spark.createDataFrame(list(now.files), "_file string, _version long")
    return out.withColumn("_file", F.col("_metadata.file_name")).join(added, "_file").drop("_file") if files else out.withColumn("_version", F.lit(0).cast("long"))


def vacuum(path: str, older_than_s: float = 86_400.0) -> list[str]:
    """Deletes data files that the newest version doesn't name and that are old enough to be no running writer's or reader's; returns their names."""
    kept, folder, gone = {name for name, _ in latest(path).files}, os.path.join(_folder(path), "data"), []
    for name in os.listdir(folder) if os.path.isdir(folder) else ():
        if name not in kept and os.path.getmtime(os.path.join(folder, name)) < time.time() - older_than_s:
            os.unlink(os.path.join(folder, name))
            gone.append(name)
    return gone


# Stores of documents with fields: each write sets fields, the last that was committed counts, all others stay.


def set_fields(fields: DataFrame, path: str) -> None:
    """Sets fields (key, field, value as JSON) of documents. Of several values of a field in one write the greatest counts; a null value takes the field away; rows without key or field are left out."""
    write(fields.select("key", "field", "value").where("key is not null and field is not null").groupBy("key", "field").agg(F.max("value").alias("value")), path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """key, fields (map of field to JSON) of the documents of a store."""
    rows = read(spark, path, with_version=True)
    last = rows.groupBy("key", "field").agg(F.max_by("value", "_version").alias("value")).where("value is not null")
    return last.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def compact(spark: SparkSession, path: str) -> int:
    """Rewrites a store's newest values into files of one commit that takes the place of those read; what others commit meanwhile stays. Returns the version's number."""
    base = latest(path)
    rows = read(spark, path, with_version=True)
    last = rows.groupBy("key", "field").agg(F.max_by("value", "_version").alias("value")).where("value is not null")
    made = f"{path.rstrip('/')}/_compact-{uuid.uuid4().hex}"
    write(last, made)
    folder, names = _folder(path), [name for name, _ in latest(made).files]
    for name in names:
        os.rename(os.path.join(_folder(made), "data", name), os.path.join(folder, "data", name))
    read_files = {name for name, _ in base.files}
    return commit(path, lambda now: ([*((name, base.number) for name in names), *(f for f in now.files if f[0] not in read_files)], now.schema))
