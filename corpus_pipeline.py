"""A corpus pipeline: each stage takes the documents that its predecessor kept and hands on its own."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from feedmill.llm import bpe, common, decontaminate, langid, simhash, toxicity
from feedmill.storage import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of ids (8 bytes each) up to which a stage broadcasts those that it drops.
BROADCAST_IDS = 500_000
#: Share of a text's words that must be of its language.
LEAST_SHARE = 0.5


def _without(docs, ids):
    """docs but for those ids; rows without an id stay. Columns other than COLUMNS go."""
    ids = common.written(ids.where("doc_id is not null").distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark, docs, sf_dir):
    """Documents with a toxicity score below 0.5 stay; the model learns from their labels.

    Null and empty texts hold no passage and stay, repeated rows repeat, a row without an id is judged by its text; an empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(model)("text") < 0.5).select(*COLUMNS)


def known_language(spark, docs, sf_dir):
    """Documents of which one learned language makes up LEAST_SHARE of the words stay; und goes, and so do null and empty texts.

    Repeated rows repeat, a row without an id is judged by its text; an empty table stays empty.
    """
    language = langid.language_column(langid.fit(docs), spark)("text")
    return docs.withColumn("found", language).where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_SHARE)).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays, that with the least doc_id, and one row of it; rows without an id stay.

    SimHash fingerprints name the first candidates, shared rare shingles those that fingerprints miss; all are compared exactly.
    """
    groups = common.written(simhash.similar_groups(docs), "groups")
    kept = _without(docs, groups.where("doc_id <> component_id").select("doc_id"))
    twice = common.written(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    return _without(kept, twice).unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS))


def decontaminated(spark, docs, sf_dir):
    """Documents without a benchmark passage stay; of an id with several texts all go if one leaks.

    Null and empty texts leak nothing. Rows without an id are searched in a second pass, where a hash of the text stands for it.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null").withColumn("doc_id", F.xxhash64("text"))
    kept = _without(named, decontaminate.leaks(named, items).select("doc_id"))
    if nameless.isEmpty():
        return kept
    return kept.unionByName(_without(nameless, decontaminate.leaks(nameless, items).select("doc_id")).withColumn("doc_id", F.lit(None).cast("long")))


def tokenized(spark, docs, sf_dir):
    """Token ids of each document, and digests of them and of the bytes that they decode to; a row for every row."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("language ID", known_language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminated), ("byte-level BPE", tokenized)]
#: Models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents table, each written as Parquet in the shared folder and read again by the next; what a stage wrote for itself goes with it, its result after the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark):
            kept = common.written(stage(spark, docs, sf_dir), "stage", outlives=True)
        common.forget(docs)
        docs = kept
    return docs
