import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from feedmill.llm import simhash, toxicity
from tests.llm.test_formats import brute_leaks
from tests.llm.test_neardup import brute_components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(number))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_stages_keep_columns_and_only_take_away(spark, stages):
    before = set(texts(spark.read.parquet(f"{DATA}/documents.parquet")))
    for _, frame in stages[:-1]:
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS
        assert set(texts(frame)) <= before
        before = set(texts(frame))
    assert {r.doc_id for r in stages[-1][1].select("doc_id").collect()} == before


def test_dropped_by_toxicity_are_those_that_score(spark, stages):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()
    assert set(texts(stages[0][1])) == {r.doc_id for r in scored if r.score < 0.5}


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after = texts(stages[1][1]), set(texts(stages[2][1]))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in before.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert after == set(brute_components(list(sets), linked).values())


def test_leaks_go_and_clean_documents_stay(spark, stages):
    before, after = texts(stages[2][1]), set(texts(stages[3][1]))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    pool = {w for _, t in items for w in zip(*(t.lower().split()[k:] for k in range(3)), strict=False)}
    near = [(i, t) for i, t in before.items() if pool & set(zip(*(t.lower().split()[k:] for k in range(3)), strict=False))]
    assert set(before) - after == {d for d, *_ in brute_leaks(near, items)}


def test_repeated_rows_and_null_ids_in_the_pipeline(spark):
    rows = [(1, "the same words again and again here", "en", "a", 1), (1, "the same words again and again here", "en", "a", 1), (2, "the same words again and again here", "en", "b", 1), (None, "no id", "en", "c", 1), (3, None, None, None, None)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DATA).collect()
    assert sorted((str(r.doc_id) for r in out)) == ["1", "3", "None"]


def test_every_operator_has_a_query():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("name", ["op1_embedding_neardup", "op6_decontaminate", "op7_chat", "op8_warc"])
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    frame = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    rel = con.execute(__spark_entry__.oracle_sql()[name])
    order = [[d[0] for d in rel.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
