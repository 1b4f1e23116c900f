"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from feedmill.llm import bpe, chat, decontaminate, langid, licenses, merkle, neardup_embeddings, quality, simhash, tokencount, toxicity, warc, whitening
from feedmill.llm.common import bucket_of

#: Rank file and pattern that the encoding query takes.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Tokenizer whose tokens the counting query counts.
COUNTED = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark, sf_dir):
    return neardup_embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_simhash_neardup(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark, sf_dir):
    return bpe.round_trip(_read(spark, sf_dir, "documents"), RANKS, PATTERN)


def op6_decontaminate(spark, sf_dir):
    found = decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


def op7_chat(spark, sf_dir):
    return chat.canonical(_read(spark, sf_dir, "conversations"))


def op8_warc(spark, sf_dir):
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op9_quality(spark, sf_dir):
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_language_id(spark, sf_dir):
    return langid.language_id(_read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    docs, text = _read(spark, sf_dir, "documents"), F.col("text")
    return merkle.manifest(docs, F.when(bucket_of(F.col("doc_id"), 3) == 0, merkle.tampered_text(text)))


def op12_token_counts(spark, sf_dir):
    return tokencount.counted(_read(spark, sf_dir, "documents"), COUNTED)


def op13_whitening(spark, sf_dir):
    return whitening.whitened(_read(spark, sf_dir, "embeddings"))


_ALL = (op1_embedding_neardup, op2_simhash_neardup, op3_toxicity, op4_license_scan, op5_byte_bpe, op6_decontaminate, op7_chat, op8_warc, op9_quality, op10_language_id, op11_merkle_manifest, op12_token_counts, op13_whitening)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {
    # Every pair of vectors, then everything in reach.
    "op1_embedding_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
good AS (SELECT * FROM ok WHERE n > 0),
pairs AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u),
comp AS (SELECT u, min(v) AS c FROM reach GROUP BY u), deg AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v JOIN comp c ON v.vec_id = c.u LEFT JOIN deg d ON v.vec_id = d.u""",
    # Windows of an item's length where a shared shingle aligns them, compared as multisets of shingles.
    "op6_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
ig AS (SELECT item_id, len(ws) AS n, unnest(range(0, len(ws) - 4)) AS p, ws FROM i), ig2 AS (SELECT item_id, n, p, array_to_string(ws[p + 1:p + 5], ' ') AS g FROM ig),
dg AS (SELECT doc_id, unnest(range(0, len(ws) - 4)) AS p, ws FROM d), dg2 AS (SELECT doc_id, p, len(ws) AS m, array_to_string(ws[p + 1:p + 5], ' ') AS g FROM dg),
laid AS (SELECT DISTINCT doc_id, n, greatest(0, least(dg2.p - ig2.p, m - n)) AS start FROM dg2 JOIN ig2 ON dg2.g = ig2.g),
w AS (SELECT laid.*, d.ws[start + 1:start + n] AS ws FROM laid JOIN d USING (doc_id)),
wu AS (SELECT doc_id, n, start, ws, len(ws) - 4 AS size, unnest(range(0, len(ws) - 4)) AS p FROM w),
wg AS (SELECT doc_id, n, start, size, array_to_string(ws[p + 1:p + 5], ' ') AS g, count(*) AS k FROM wu GROUP BY ALL),
ic AS (SELECT item_id, n, n - 4 AS size, g, count(*) AS k FROM ig2 GROUP BY ALL),
s AS (SELECT doc_id, item_id, wg.start, wg.n, sum(least(wg.k, ic.k)) AS common, any_value(wg.size + ic.size) AS sizes FROM wg JOIN ic ON wg.g = ic.g AND wg.n = ic.n GROUP BY doc_id, item_id, wg.start, wg.n),
f AS (SELECT doc_id, item_id, start, n, common / (sizes - common) AS similarity FROM s WHERE common / (sizes - common) >= 0.8)
SELECT doc_id, item_id, start, CAST(n AS BIGINT) AS n_words, round(similarity, 6) AS similarity FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1""",
    # Texts without tool calls, as those of the tables here; fixtures test the rest.
    "op7_chat": """
SELECT conv_id, turn, CAST(0 AS BIGINT) AS part, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS BOOLEAN) AS linked, CAST(NULL AS BOOLEAN) AS valid, turn AS after, CAST(0 AS BIGINT) AS level,
  '{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(coalesce(role, '')) || ',"type":"message"}' AS json FROM conversations""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t""",
    # Levels of all trees at once, then each leaf folded upwards; crc32 a byte and then eight bits at a time.
    "op11_merkle_manifest": r"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, *, coalesce('=' || lang, '') AS tree, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([ord(c)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))) AS bytes FROM documents),
f AS (SELECT *, coalesce(xor(4294967295, list_reduce(bytes, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % 3 = 0, false) AS hit,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM r),
l AS (SELECT rid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS lower_leaf, hit FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
up AS (SELECT 0 AS level, tree, idx, n, leaf AS d FROM p UNION ALL SELECT level + 1, tree, idx // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY level, tree, idx // 8, n),
s AS (SELECT tree AS name, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, idx, n, subroot AS d FROM s UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 8, n),
runs AS (SELECT tree, level, idx // 8 AS k, string_agg(d, '' ORDER BY idx) AS run FROM up WHERE n > 1 GROUP BY ALL),
tops AS (SELECT level, idx // 8 AS k, string_agg(d, '' ORDER BY idx) AS run FROM top WHERE n > 1 GROUP BY ALL),
a AS (SELECT rid, 0 AS level, tree, idx, n, CASE WHEN hit THEN lower_leaf ELSE leaf END AS cur, '' AS proof FROM p
  UNION ALL SELECT rid, a.level + 1, a.tree, idx // 8, (n + 7) // 8, sha256(run[:idx % 8 * 64] || cur || run[idx % 8 * 64 + 65:]), proof || run[:idx % 8 * 64] || run[idx % 8 * 64 + 65:] FROM a JOIN runs ON a.tree = runs.tree AND a.level = runs.level AND idx // 8 = k),
b AS (SELECT rid, 0 AS level, subroot, s.idx, s.n, cur, proof FROM a JOIN s ON a.tree = s.name WHERE a.n = 1
  UNION ALL SELECT rid, b.level + 1, subroot, idx // 8, (n + 7) // 8, sha256(run[:idx % 8 * 64] || cur || run[idx % 8 * 64 + 65:]), proof || run[:idx % 8 * 64] || run[idx % 8 * 64 + 65:] FROM b JOIN tops ON b.level = tops.level AND idx // 8 = k)
SELECT doc_id, leaf, subroot, root.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root.d AS verified FROM b JOIN p USING (rid), (SELECT d FROM top WHERE n = 1) root WHERE b.n = 1""",
}
