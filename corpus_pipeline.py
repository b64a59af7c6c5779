"""A corpus pipeline over ``documents``: each stage takes and returns that table, the last one returns token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaqual.llm import line_dedup, mixing, sentencepiece_codec, simhash, toxicity
from areaqual.llm.common import remainder, stored
from areaqual.llm.queries import MIN_WORDS, TOKENIZER, table

#: No SQL for the stages: hashes, learned trees and token ids; the tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the rows that op7 learns from."""
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines and runs of lines are deleted from the texts."""
    return line_dedup.delete_repeats(docs, MIN_WORDS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until each source has its share of words."""
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_ids and exact (the ids decode to the text) of every row."""
    return sentencepiece_codec.encode(docs, TOKENIZER, ("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("mixing to target weights", mix_sources),
    ("sentencepiece", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
