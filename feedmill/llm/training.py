"""Bounded samples of labelled rows, written where tasks can read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedmill.llm.common import bucket_of, small_batches, written

#: Characters beyond which a text is sampled only after all others.
LONG = 200_000


def _one_text(found: DataFrame, *more: str) -> DataFrame:
    """text, label and more of one row for each doc_id: of several texts the least."""
    return found.groupBy("doc_id").agg(F.min(F.struct("text", "label", *more)).alias("row")).select("row.*")


def _fitting(sample: DataFrame, chars: int) -> DataFrame:
    """Of a written sample (text, label, ...) the texts that a fit holds at once: those of a label in an order by hash, long ones last, until they have their label's share of so many characters; one text of each label at least."""
    labels = max(1, sample.select("label").distinct().count())
    size = F.length(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("label").orderBy((size > LONG).cast("int"), F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, -1)
    return sample.withColumn("_before", F.sum(size).over(order)).where(F.coalesce("_before", F.lit(0)) * labels < chars).drop("_before")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, chars: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(text, label) and more columns of at most `rows` labelled documents outside the held-out fold, with about `chars` characters in all, in an order by hash of the id.

    The ids of the sample are broadcast: at most `rows` of them, 12 bytes each. A null label is no label;
    of repeated labels of a document the largest counts; of several texts of a document the least is taken.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(bucket_of(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).join(F.broadcast(chosen), "doc_id")
    return written(_fitting(written(_one_text(found, *more), "labelled"), chars), "sample")


def sample_by_class(docs: DataFrame, label: str, folds: int, held_out: int, rows: int, most: int, chars: int) -> DataFrame:
    """(text, label) of at most `rows` documents of every label that the documents carry themselves, and about `most` with `chars` characters in all.

    With so many labels that they would be more than `most`, each gets an equal share, one document at least.
    Of a document's labels and texts the least are taken.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null and doc_id is not null")
    own = own.where(bucket_of(F.col("doc_id"), folds) != held_out)
    labels = own.select("label").distinct().count()
    each = max(1, min(rows, most // max(1, labels)))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = own.select("doc_id", "label").withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).groupBy("doc_id").agg(F.min("label").alias("label"))
    found = own.join(F.broadcast(ids) if labels * each <= 2 * most else ids, ["doc_id", "label"])
    return written(_fitting(written(_one_text(found), "labelled"), chars), "sample")
