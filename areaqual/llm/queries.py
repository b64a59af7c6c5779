"""The driver queries of the subpackage and their SQL counterparts. Each takes (spark, sf_dir)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaqual.llm import alignment, embedding_dups, language, lexical, licenses, line_dedup, mixing, order_minhash, sentencepiece_codec
from areaqual.llm import sharding, simhash, topk, toxicity
from areaqual.llm.common import remainder

TOKENIZER = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BYTE_TOKENIZER = os.environ.get("BYTE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
SHARD_BYTES = 1 << 20
MIN_WORDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(n: int, k: int):
    return F.coalesce(remainder(F.col("doc_id"), n) == k, F.lit(False))


def op1_language_id(spark, d):
    docs = table(spark, d, "documents")
    model = language.learn_languages(docs, remainder(F.col("doc_id"), 5) != 0)
    found = language.identify_language(docs, model)
    return found.select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score", "bits")


def op2_embedding_near_dedup(spark, d):
    return embedding_dups.near_duplicates(table(spark, d, "embeddings"))


def op3_simhash_near_dedup(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"), shingle=3, max_bits=3)


def op4_exact_top_k(spark, d):
    return topk.top_k(topk.quantized(table(spark, d, "embeddings"), 64), F.col("vec_id") % 20 == 0, k=20)


def op5_line_dedup(spark, d):
    docs = table(spark, d, "documents")
    return line_dedup.delete_repeats(docs, MIN_WORDS).select("doc_id", "n_chars", F.md5("text").alias("text_md5"))


def op6_source_mix(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_toxicity(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.learn_toxicity(docs, table(spark, d, "labels"), remainder(F.col("doc_id"), 3) != 1)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op8_extendible_shards(spark, d):
    return sharding.assign_shards(table(spark, d, "documents"), SHARD_BYTES)


def op9_licence_scan(spark, d):
    return licenses.scan_licences(table(spark, d, "documents"))


def op10_sentencepiece(spark, d):
    return sentencepiece_codec.encode(table(spark, d, "documents"), TOKENIZER)


def op11_order_minhash(spark, d):
    return order_minhash.edit_likeness(table(spark, d, "documents"))


def op12_token_alignment(spark, d):
    return alignment.alignment_counts(table(spark, d, "documents"), BYTE_TOKENIZER, TOKENIZER)


def op13_lexical_search(spark, d):
    return lexical.ranked_search(table(spark, d, "documents"), table(spark, d, "benchmark"), k=10)


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_embedding_near_dedup, op3_simhash_near_dedup, op4_exact_top_k, op5_line_dedup, op6_source_mix,
        op7_toxicity, op8_extendible_shards, op9_licence_scan, op10_sentencepiece, op11_order_minhash, op12_token_alignment,
        op13_lexical_search, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op4_exact_top_k": """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20""",
    "op8_extendible_shards": f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
    CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(bytes) AS shard_bytes, count(*) AS shard_docs
  FROM r, (SELECT unnest(range(61)) AS depth) GROUP BY ALL
), f AS (
  SELECT r.doc_id, s.*, r.bytes, row_number() OVER (PARTITION BY r.doc_id, r.h ORDER BY s.depth) AS k
  FROM s JOIN r ON s.prefix = r.h >> (60 - s.depth) WHERE s.shard_bytes <= {SHARD_BYTES}
)
SELECT doc_id, CAST(depth AS INTEGER) AS depth, CAST(prefix AS BIGINT) AS prefix, CAST(0 AS BIGINT) AS part,
  CAST(bytes AS BIGINT) AS bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_docs AS BIGINT) AS shard_docs
FROM f WHERE k = 1""",
    "op13_lexical_search": r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), n AS (
  SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
), s AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n
), m AS (
  SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM n, s
), q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * CAST(docs AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w
  FROM p, s GROUP BY term, docs
), r AS (
  SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10""",
}
