"""Queries of this subpackage, one per operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import bpe, covertree, langid, licenses, lm, media, mixing, simhash, substring, warc
from sylvan.llm.shared import documents, fresh_path

#: Where the public tokenizer files are; a parameter of the BPE operator.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(documents(spark, sf_dir), ["doc_id"])
    return media.inspect(stored, ["doc_id", "n_bytes"])


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(documents(spark, sf_dir))


def op6_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path(), ["doc_id"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read(spark, path).drop("url")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir), ["doc_id"]).drop("matches")


QUERIES = {f.__name__: f for f in (op1_langid, op2_substring, op3_mixing, op4_media, op5_lm, op6_covertree, op7_bpe, op8_warc, op9_simhash, op10_licenses)}

#: op2 as SQL: every 13-word window, its first document, and the words that later ones cover.
ORACLES = {
    "op2_substring": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM h) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM r),
k AS (SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(ks, x)), lambda x: ws[x]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""",
    "op6_covertree": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (vec_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS s FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::BIGINT + 1, 1)), '') AS digest FROM f)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
}
