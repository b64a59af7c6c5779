"""Checks that stop a run, and counts that only inform."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class DataCheckError(AssertionError):
    """A hard check found violating rows."""


def assert_no_rows(violations: DataFrame, message: str) -> None:
    """Run now and fail when ``violations`` has a row."""
    sample = violations.limit(5).collect()
    if sample:
        raise DataCheckError(f"{message}: {[r.asDict() for r in sample]}")


def assert_known_ids(df: DataFrame, id_column: str, known: DataFrame, known_column: str) -> None:
    """Fail when a non-null id is missing from the reference layer."""
    ids = df.select(F.col(id_column).alias("id")).where(F.col("id").isNotNull()).distinct()
    unknown = ids.join(known.select(F.col(known_column).alias("id")).distinct(), "id", "left_anti")
    assert_no_rows(unknown, f"Unknown {id_column}")


def fail_when(condition: Column, message: str, value: Column) -> Column:
    """``value``, or an error raised by the executing task; costs no extra pass."""
    return F.when(condition, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def observe_counts(df: DataFrame, name: str, conditions: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """Count rows per condition while the frame is being used; read ``observation.get`` afterwards."""
    observation = Observation(name)
    metrics = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()]
    return df.observe(observation, *metrics), observation


def unmatched_keys(df: DataFrame, reference: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``reference`` lacks."""
    return df.select(*on).distinct().join(reference.select(*on).distinct(), list(on), "left_anti")


def require_unique(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """The same rows, or an error from the executing task when a key occurs twice."""
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in rest], F.count(F.lit(1)).alias("_aq_n"))
    guard = fail_when(F.col("_aq_n") > 1, message, F.col(keys[0]))
    return counted.withColumn(keys[0], guard).select(*df.columns)
