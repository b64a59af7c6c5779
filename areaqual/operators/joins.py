"""Joins beyond a plain ``df.join``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaqual.sources.sinks import Store, keep

_LEFT, _RIGHT, _TIMES = "_aq_salt_left", "_aq_salt_right", "_aq_times"
_TASKS_PER_CORE = 4


def spread(df: DataFrame, by: str) -> DataFrame:
    """The same rows over all cores, by a column. For rows that are short but much work each, as shapes are: a file below
    one split, or a shuffle of a megabyte, would be a single task however many rows it holds."""
    return df.repartition(_TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, by)


def hot_key_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], pairs_per_task: int = 16_000_000, store: Store = keep
) -> DataFrame:
    """Inner equi-join that splits every key with more than ``pairs_per_task`` pairs.

    Both sides are counted per key, with partial counts, and a key is hot by the product of its counts. Its rows are
    dealt to a grid of salts, so that a salt pair has about ``pairs_per_task`` pairs at most; both sides are copied only
    along the other side's salts. The list of hot keys stays a table. Without hot keys this is a plain join.
    Columns must be of types that can be grouped by; null keys match nothing.
    """
    on = list(on)
    counts = _counts(left, on, _LEFT).join(_counts(right, on, _RIGHT), on)
    hot = counts.where(F.col(_LEFT).cast("double") * F.col(_RIGHT) > pairs_per_task).select(
        *on, _salts(_LEFT, _RIGHT, pairs_per_task).alias(_LEFT), _salts(_RIGHT, _LEFT, pairs_per_task).alias(_RIGHT)
    )
    hot = store(hot, "hot-keys")
    plain = left.join(right, on)
    if hot.isEmpty():
        return plain
    cold = left.join(hot.select(*on), on, "left_anti").join(right, on)
    dealt = deal_rows(left, hot, on, _LEFT, _RIGHT).join(deal_rows(right, hot, on, _RIGHT, _LEFT), [*on, _LEFT, _RIGHT])
    times = F.sequence(F.lit(1).cast("long"), F.col(_LEFT + _TIMES) * F.col(_RIGHT + _TIMES))
    return cold.unionByName(dealt.withColumn(_TIMES, F.explode(times)).select(*plain.columns))


def _counts(df: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))


def _salts(own: str, other: str, pairs_per_task: int) -> Column:
    facing = F.least(F.col(other).cast("double"), F.lit(math.sqrt(pairs_per_task)))
    return F.ceil(F.col(own) * facing / pairs_per_task)


def deal_rows(df: DataFrame, hot: DataFrame, on: Sequence[str], own: str, other: str) -> DataFrame:
    """The rows of hot keys, dealt to the salts ``own`` and copied to all salts ``other``.

    Equal rows are counted and their number is shared out over the salts (``<own>_aq_times``), so that repeated rows
    spread too. Salts depend on the rows alone: a task that is run again deals alike.
    """
    same = df.join(hot, list(on)).groupBy(*df.columns, own, other).agg(F.count(F.lit(1)).alias("_aq_n"))
    shares = F.least("_aq_n", own)
    spread = same.withColumn("_aq_k", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    times = F.expr(f"_aq_n div least(_aq_n, {own}) + if(_aq_k < _aq_n % least(_aq_n, {own}), 1L, 0L)")
    salt = F.pmod(F.pmod(F.xxhash64(*df.columns), F.col(own)) + F.col("_aq_k"), F.col(own))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
    return spread.select(*df.columns, salt.alias(own), F.col(other), times.alias(own + _TIMES)).withColumn(other, copies)


def outer_with_indicator(left: DataFrame, right: DataFrame, on: Sequence[str], name: str = "indicator") -> DataFrame:
    """Full outer join that says where each row was found: ``both``, ``left_only`` or ``right_only``.

    Meant for sides that are aggregated to one row per key, so no key can be hot.
    """
    joined = left.withColumn("_aq_l", F.lit(True)).join(right.withColumn("_aq_r", F.lit(True)), list(on), "full_outer")
    origin = (
        F.when(F.col("_aq_l") & F.col("_aq_r"), "both").when(F.col("_aq_l"), "left_only").otherwise("right_only")
    )
    return joined.withColumn(name, origin).drop("_aq_l", "_aq_r")


def without_keys(df: DataFrame, excluded: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``excluded``; null keys stay."""
    return df.join(excluded.select(*on).distinct(), list(on), "left_anti")
