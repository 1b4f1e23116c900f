"""A lookup that learns: codes of a stream are asked for as long as they were not found, and never again once they were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedmill.sources import manifest

KNOWN = "code string, province string"


def known(spark, path: str) -> DataFrame:
    """code, province of all that was ever found; the first answer counts."""
    if not manifest.latest(path).number:
        return spark.createDataFrame([], KNOWN)
    return manifest.read(spark, path, with_version=True).groupBy("code").agg(F.min_by("province", F.struct("_version", "province")).alias("province"))


def resolved(codes: DataFrame, registry: DataFrame, path: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """codes with province: from the registry (code, province), else from what was found before, else asked for.

    ask: distinct codes to (code, province), null where it failed; a code that it leaves out failed too. Answers are
    written back, failures are not, so they are asked again next time. Null codes are unknown.
    """
    spark = codes.sparkSession
    before = registry.select("code", "province").unionByName(known(spark, path).join(registry.select("code"), "code", "left_anti"))
    missing = codes.select("code").where("code is not null and code <> ''").distinct().join(before.select("code"), "code", "left_anti")
    manifest.write(ask(missing).where("province is not null and province <> ''").select(F.col("code").cast("string").alias("code"), F.col("province").cast("string").alias("province")), path)
    now = registry.select("code", "province").unionByName(known(spark, path).join(registry.select("code"), "code", "left_anti"))
    return codes.join(now, "code", "left")


def resolve_stream(codes: DataFrame, registry: DataFrame, path: str, ask: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs over what a stream of codes has now: each batch is resolved and written under out/batch=<id>, which a repeated batch replaces."""

    def batch(rows: DataFrame, number: int) -> None:
        resolved(rows, registry, path, lambda missing: ask(missing, number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return codes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_province(province: Column, name: str) -> Column:
    """Whether a province is the named one; an unknown one is not."""
    return F.coalesce(province == name, F.lit(False))
