"""Connected components by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.storage import forget, written


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u long, v long): rows (id, component_id = least id).

    Alternating large and small stars; each round is written, so no lineage grows. Minima are combined
    before the shuffle and the joins back are plain equi-joins, which AQE splits for a hub with most edges.
    Ids without an edge to another id have no row; nulls and loops are skipped.
    """
    now = written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign[0] == 0 or sign == mark:
            break
        mark = sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        forget(now)
        forget(large)
        now = after
    tops = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(tops)
