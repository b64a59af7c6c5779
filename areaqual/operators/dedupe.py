"""Keep one row per key.

``row_number() = 1`` is planned with a partial group limit below the exchange: every input task
forwards at most one row per key, so a key that holds a third of all rows does not build up in
one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_aq_rank"


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the smallest by ``order``. Null keys count as equal."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) == 1).drop(_RANK)


def keep_latest(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row per key with the largest ``by``; ``ties`` decide between equal ones."""
    return keep_first(df, keys, [F.col(by).desc_nulls_last(), *ties])


def keep_highest_label(df: DataFrame, keys: Sequence[str], label: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row per key with the last label in text order."""
    return keep_latest(df, keys, label, ties)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
