"""Aggregations with the null, rounding and ratio rules of the eligibility tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaqual import constants as K
from areaqual.functions import numeric
from areaqual.operators.sums import exact_sums


def annual_mean(df: DataFrame, keys: Sequence[str], value: str, name: str, digits: int = 1) -> DataFrame:
    """Mean per key rounded half-even; rows without a key or value do not count."""
    means = df.dropna(subset=list(keys)).groupBy(*keys).agg(numeric.round_half_even(F.avg(value), digits).alias(name))
    return means.dropna(subset=[name])


def conditional_annual_means(
    df: DataFrame, keys: Sequence[str], value: str, parts: dict[str, Column], digits: int = 1
) -> DataFrame:
    """One rounded mean per named condition, side by side: a pivot in a single shuffle."""
    means = [
        numeric.round_half_even(F.avg(F.when(condition, F.col(value))), digits).alias(name)
        for name, condition in parts.items()
    ]
    return df.groupBy(*keys).agg(*means)


def industry_totals(facts: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Facts summed per key, industry code and "is a total row".

    Primitive sums only, so this runs as a hash aggregate with map-side combine and cuts the fact
    table to a few rows per key before anything else happens.
    """
    is_total = (F.col("industry_code") == K.TOTAL_INDUSTRY_CODE) & (F.col("own_code") == K.TOTAL_OWNERSHIP_CODE)
    return facts.groupBy(*keys, "industry_code", F.coalesce(is_total, F.lit(False)).alias("is_total")).agg(
        F.sum("annual_avg_emplvl").alias("employees"), *extra
    )


def code_shares(
    totals: DataFrame,
    keys: Sequence[str],
    is_part: Column,
    threshold: float = K.FOSSIL_SHARE_THRESHOLD,
) -> DataFrame:
    """Share of the marked industries in total employment, from :func:`industry_totals` rows.

    A key without any total row has no total (and no share); one without marked rows has 0. Keys
    with neither do not occur.
    """
    part = F.coalesce(is_part, F.lit(False))
    return (
        totals.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.count_if("is_total").alias("_aq_total_rows"),
            F.count_if(part).alias("_aq_part_rows"),
            F.coalesce(F.sum(F.when(F.col("is_total"), F.col("employees"))), F.lit(0)).alias("_aq_total"),
            F.coalesce(F.sum(F.when(part, F.col("employees"))), F.lit(0)).alias("fossil_employees"),
            F.sort_array(F.collect_set(F.when(part, F.col("industry_code")))).alias("naics_code"),
        )
        .where("_aq_total_rows > 0 OR _aq_part_rows > 0")
        .withColumn("total_employees", F.when(F.col("_aq_total_rows") > 0, F.col("_aq_total")))
        .withColumn("naics_code", F.when(F.col("_aq_part_rows") > 0, F.col("naics_code")))
        .withColumn("percent_fossil_employment", numeric.ratio(F.col("fossil_employees"), F.col("total_employees")))
        .withColumn("meets_fossil_employment_threshold", share_flag(threshold))
        .drop("_aq_total_rows", "_aq_part_rows", "_aq_total")
    )


def share_flag(threshold: float) -> Column:
    """Strictly above the threshold; part of nothing (x / 0) is above every threshold."""
    infinite = (F.col("total_employees") == 0) & (F.col("fossil_employees") > 0)
    return F.when(infinite, 1).otherwise(numeric.flag(F.col("percent_fossil_employment") > F.lit(threshold)))


def area_rates(df: DataFrame, keys: Sequence[str], part: str, whole: str, name: str) -> DataFrame:
    """Ratio of sums per key, floored to three decimals, as a percentage. A zero whole gives null."""
    total_part = F.coalesce(F.sum(part), F.lit(0.0))
    total_whole = F.coalesce(F.sum(whole), F.lit(0.0))
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(numeric.floor_percent(numeric.ratio(total_part, total_whole)).alias(name))
    )


def exact_median(df: DataFrame, column: str, buckets: int = 4096) -> DataFrame:
    """One-row frame with the exact median, without bringing values together.

    The two middle ranks are searched one after the other. Each round counts the values still in view in ``buckets``
    buckets and goes on with the range of the one that holds the rank, until that is a single value. Buckets are of
    equal width on a logarithmic scale first, then, within a factor of two, on the values themselves; so about six
    rounds reach the width of a double, whatever the values and their number.
    """
    known = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).cast("double").alias("v"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not size["n"]:
        return df.sparkSession.createDataFrame([(None,)], "median double")
    first, second = (size["n"] + 1) // 2, (size["n"] + 2) // 2
    low, upto = _value_at(known, first, size["lo"], size["hi"], buckets)
    high = low
    if second > upto:  # the next larger value
        high = known.where(F.col("v") > low).agg(F.min("v")).first()[0]
    return df.sparkSession.createDataFrame([(low / 2 + high / 2 if abs(low) > 1e300 else (low + high) / 2,)], "median double")


def _value_at(known: DataFrame, rank: int, lo: float, hi: float, buckets: int) -> tuple[float, int]:
    """The value at a rank and the number of values up to it."""
    below, n = 0, known.count() if lo == hi else 0
    while lo < hi:
        histogram = (
            known.where(F.col("v").between(lo, hi))
            .groupBy(_bucket(lo, hi, buckets).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("b")
            .collect()
        )
        for h in histogram:
            if below + h["n"] >= rank:
                lo, hi, n = h["lo"], h["hi"], h["n"]
                break
            below += h["n"]
    return lo, below + n


def _bucket(lo: float, hi: float, buckets: int) -> Column:
    """The bucket of ``v``: rising, and not the same for the smallest and the largest value."""

    def scale(x: float) -> float:
        return math.copysign(math.log(abs(x)) + 750, x) if x else 0.0

    near = lo * hi > 0 and max(abs(lo), abs(hi)) <= 2 * min(abs(lo), abs(hi))
    start, end = (lo, hi) if near else (scale(lo), scale(hi))
    of = F.col("v") if near else F.when(F.col("v") == 0, 0.0).otherwise(F.signum("v") * (F.ln(F.abs("v")) + 750))
    width = (end - start) / buckets
    if not 0 < width < math.inf or start + width == start:
        return F.when(F.col("v") > lo / 2 + hi / 2, 1).when(F.col("v") == hi, 1).otherwise(0).cast("long")
    inner = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((of - start) / width)))
    return F.when(F.col("v") == lo, 0).when(F.col("v") == hi, buckets - 1).otherwise(inner).cast("long")


def acreage_three_ways(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sums per key with missing values left out, set to the overall mean, and set to the overall median.

    The fill-in is the same for every missing value, so one aggregate per key is enough: the exact sum of
    the known values plus the fill times the number of missing ones. No sum depends on the order of the rows.
    """
    known = df.select(key, numeric.nan_to_null(F.col(value).cast("double")).alias("_aq_value"))
    overall = exact_sums(known, [], {"total": F.col("_aq_value")}, {"n": F.col("_aq_value").isNotNull()})
    mean = overall.select(F.col("total") / F.nullif(F.col("n"), F.lit(0))).scalar()
    median = exact_median(known, "_aq_value").scalar()
    per_key = exact_sums(
        known.dropna(subset=[key]), [key], {"_aq_sum": F.col("_aq_value")}, {"_aq_missing": F.col("_aq_value").isNull()}
    ).fillna(0.0, ["_aq_sum"])

    def filled(fill: Column) -> Column:
        # Without any known value there is no fill either, and the sum stays 0.
        return numeric.round_half_even(F.col("_aq_sum") + F.col("_aq_missing") * F.coalesce(fill, F.lit(0.0)), 2)

    return per_key.select(
        key,
        numeric.round_half_even(F.col("_aq_sum"), 2).alias(value),
        filled(mean).alias(f"{value}_mean_fill"),
        filled(median).alias(f"{value}_median_fill"),
    )
