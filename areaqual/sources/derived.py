"""Tables that are derived from another one and stored beside it, with proof of what they were made from.

The proof is a row written after the table: the fingerprint of the source and that of the table itself. A table whose
source has changed since, that is incomplete, or has no proof, is not used.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaqual.operators.fingerprints import FIELDS, table_fingerprint

log = logging.getLogger(__name__)


def _proof(path: str) -> str:
    return f"{path.rstrip('/')}.proof"


def _own(table: DataFrame) -> DataFrame:
    return table_fingerprint(table, [F.col(c) for c in sorted(table.columns)])


def write_derived(df: DataFrame, path: str, source: DataFrame) -> DataFrame:
    """Write a table and then its proof; ``source`` is the fingerprint of what it was made from, one row."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    fields = [f"source_{f}" for f in FIELDS] + FIELDS
    kinds = ["long", "string", "long"] * 2
    proof = spark.createDataFrame([(*source.first(), *_own(table).first())], ", ".join(f"{f} {k}" for f, k in zip(fields, kinds)))
    proof.coalesce(1).write.mode("overwrite").parquet(_proof(path))
    return table


def read_derived(spark: SparkSession, path: str, source: DataFrame) -> DataFrame | None:
    """The stored table, or nothing if it is missing, incomplete, or made from anything else."""
    try:
        table, proof = spark.read.parquet(path), spark.read.parquet(_proof(path)).first()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        log.info("Nothing stored, or without proof, at %s", path)
        return None
    made_from, now, own = tuple(proof[f"source_{f}"] for f in FIELDS), tuple(source.first()), tuple(_own(table).first())
    if made_from != now or own != tuple(proof[f] for f in FIELDS):
        log.warning("%s was made from something else or is incomplete: made from %s, now %s", path, made_from, now)
        return None
    return table
