"""Merkle manifest of a dataset: a tree for each language, a tree over their roots, and a proof for each document.

H is the lowercase hex SHA-256 of its inputs, digests taken as hex text. Leaves stand by language and id and get
places in two passes, without a window over a language. Runs of BLOCK leaves are blocks: DuckDB in a task makes the
levels of one block at a time with ordered string_agg and sha256. Spark joins block roots to trees, eight to a node,
and hands each block the siblings above it, so that proofs never travel with leaves.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmill.llm.common import written

#: Nodes that make up one node above, levels of a block, and leaves of a block: those that one task holds.
FANOUT, LEVELS = 8, 4
BLOCK = FANOUT**LEVELS
#: Rows of places (about 50 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """UTF-8 byte count, colon, value; - for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column | str = "text") -> Column:
    """Leaf of a row with FIELDS, with that text in place of its own."""
    return F.sha2(F.concat(*[framed(F.col(c)) for c in FIELDS[:-1]], framed(F.col(text) if isinstance(text, str) else text)), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx (from 0, by `order` within their tree) and n (rows of the tree), written.

    Rows are range-partitioned by tree, order and chance, so equal rows spread too; a second pass adds up the
    counts of (tree, partition), of which a tree has no more than there are partitions.
    """
    by = ["tree", *order]
    spread = rows.withColumn("_chance", F.rand(11))
    spread = spread.repartitionByRange(*by, "_chance").sortWithinPartitions(*by, "_chance").drop("_chance")
    laid = written(spread.withColumn("_at", F.monotonically_increasing_id()), "laid").withColumn("_part", F.shiftright("_at", 33))  # the partition; the lower bits are the place within it
    runs = laid.groupBy("tree", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("n", F.sum("_rows").over(Window.partitionBy("tree"))).drop("_rows")
    runs = written(runs, "runs")
    out = laid.join(F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs, ["tree", "_part"])
    return out.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_before", "_first")


def _steps(n: int) -> int:
    """Levels above n nodes until one remains."""
    steps = 0
    while n > 1:
        n, steps = -(-n // FANOUT), steps + 1
    return steps


_RUNS = f"CREATE OR REPLACE TEMP TABLE run{{level}} AS SELECT k // {FANOUT} AS k, string_agg(d, '' ORDER BY k) AS run, sha256(string_agg(d, '' ORDER BY k)) AS d FROM {{source}} GROUP BY k // {FANOUT}"
_FOLD = f"""CREATE OR REPLACE TEMP TABLE fold{{level}} AS
WITH beside AS (SELECT f.row, f.k // {FANOUT} AS k, f.cur, f.proof, left(r.run, 64 * (f.k % {FANOUT})) AS before, substr(r.run, 64 * (f.k % {FANOUT}) + 65) AS after FROM {{source}} f JOIN run{{level}} r ON f.k // {FANOUT} = r.k)
SELECT row, k, sha256(before || cur || after) AS cur, proof || before || after AS proof FROM beside"""
_ENGINE: list = []


def _engine() -> duckdb.DuckDBPyConnection:
    """DuckDB of this worker: one thread, one block at a time."""
    if not _ENGINE:
        _ENGINE.append(duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB"}))
    return _ENGINE[0]


def _levels(con: duckdb.DuckDBPyConnection, block: pa.Table) -> int:
    """Makes run0, run1, ... of a block with columns idx, n, leaf; returns their number: LEVELS, or as many as a smaller tree has."""
    con.register("block", block)
    con.execute(f"CREATE OR REPLACE TEMP TABLE node AS SELECT idx % {BLOCK} AS k, leaf AS d FROM block")
    levels = min(LEVELS, _steps(block["n"][0].as_py()))
    for level in range(levels):
        con.execute(_RUNS.format(level=level, source=f"run{level - 1}" if level else "node"))
    return levels


_ROOT = "tree string, idx long, n long, d string"


def _block_root(block: pa.Table) -> pa.Table:
    con = _engine()
    levels = _levels(con, block)
    ((digest,),) = con.execute(f"SELECT d FROM {f'run{levels - 1}' if levels else 'node'}").fetchall()
    n = block["n"][0].as_py()
    con.unregister("block")
    return pa.table({"tree": [block["tree"][0].as_py()], "idx": [block["block"][0].as_py()], "n": [-(-n // BLOCK)], "d": [digest]})


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (tree, d) over nodes (tree, idx, n, d), and for each level (tree, idx, before, after): the siblings of each node there, as text.

    A group is one run of FANOUT nodes; a level is FANOUT times smaller than that below. Trees of one node have no level.
    """
    roots, levels = nodes.where("n = 1").select("tree", "d"), []
    nodes = nodes.where("n > 1")
    while not nodes.isEmpty():
        runs = nodes.groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("up"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "d"))).alias("run"))
        runs = written(runs.withColumn("text", F.array_join(F.col("run.d"), "")), "level")
        place = (F.col("child.idx") % FANOUT * 64).cast("int")
        levels.append(runs.select("tree", F.explode("run").alias("child"), "text").select("tree", F.col("child.idx").alias("idx"), F.substring("text", F.lit(1), place).alias("before"), F.substring("text", place + 65, F.lit(64 * FANOUT)).alias("after")))
        above = runs.select("tree", F.col("up").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), F.sha2("text", 256).alias("d"))
        roots = roots.unionByName(above.where("n = 1").select("tree", "d"))
        nodes = above.where("n > 1")
    return roots, levels


def above(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """nodes (tree, idx, ...) with outer: the siblings (before, after) at each of those levels, from the lowest."""
    nodes = nodes.withColumn("outer", F.expr("array()").cast("array<struct<before:string,after:string>>"))
    for number, level in enumerate(levels):
        mine = level.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.struct("before", "after").alias("_pair"))
        nodes = nodes.join(mine, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("idx") / FANOUT**number) == F.col("_idx")), "left")
        nodes = nodes.withColumn("outer", F.when(F.col("_pair").isNull(), F.col("outer")).otherwise(F.concat("outer", F.array("_pair")))).drop("_tree", "_idx", "_pair")
    return nodes


_PROVEN = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def _proven(block: pa.Table, outer: pa.Table) -> pa.Table:
    """Proofs and folds of a block; outer is one row with the siblings above it and the root of its tree."""
    con = _engine()
    levels = _levels(con, block)
    source = f"(SELECT idx AS row, idx % {BLOCK} AS k, coalesce(altered, leaf) AS cur, '' AS proof FROM block)"
    for level in range(levels):
        con.execute(_FOLD.format(level=level, source=source))
        source = f"fold{level}"
    outward = "s.cur", "s.proof"
    for pair in outer["outer"][0].as_py():
        outward = f"sha256('{pair['before']}' || {outward[0]} || '{pair['after']}')", f"{outward[1]} || '{pair['before']}{pair['after']}'"
    answer = con.sql(f"SELECT b.doc_id, b.leaf, '{outer['subroot'][0].as_py()}' AS subroot, sha256({outward[1]}) AS proof_sha256, {outward[0]} AS folded_root FROM block b JOIN {source} s ON s.row = b.idx").to_arrow_table()
    con.unregister("block")
    return answer.cast(pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))]))


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs, which has FIELDS.

    altered: the text that a row is tampered to, null where it is not; only folded_root and verified depend on it.
    Null fields are framed as -; rows without lang form a tree that comes first, rows without doc_id come first
    in their tree. Rows of one id stand in the order of their leaves; equal rows are leaves each. Other columns
    are ignored; an empty table has no root and gives no row.
    """
    own = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS], (altered if altered is not None else F.lit(None)).cast("string").alias("_altered"))
    leaves = own.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        "doc_id",
        leaf_of().alias("leaf"),
        F.when(F.col("_altered").isNotNull(), leaf_of("_altered")).alias("altered"),
    )
    blocks = placed(leaves, ["doc_id", "leaf"]).withColumn("block", F.floor(F.col("idx") / BLOCK))
    block_roots = written(blocks.select("tree", "block", "idx", "n", "leaf").groupBy("tree", "block").applyInArrow(_block_root, _ROOT), "block_roots")
    subroots, levels = climb(block_roots)
    subroots = written(subroots, "subroots")
    forest = written(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "d"), ["name"]), "forest")
    top, upper = climb(forest.select("tree", "idx", "n", "d"))
    root = top.first()
    named = above(forest, upper).select(F.col("name").alias("tree"), F.col("d").alias("subroot"), F.col("outer").alias("_upper"))
    outer = above(block_roots.select("tree", "idx"), levels).join(named, "tree").select("tree", F.col("idx").alias("block"), "subroot", F.concat("outer", "_upper").alias("outer"))
    proven = blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInArrow(_proven, _PROVEN)
    root = F.lit(root.d if root else None).cast("string")
    return proven.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", F.equal_null("folded_root", root).alias("verified"))
