"""Number column expressions: coercion, half-even rounding, guarded ratios and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from areaqual.functions import text


def nan_to_null(c: Column) -> Column:
    """Spark orders NaN above every number, so a threshold would accept it."""
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """Parse text to double; anything that is not a finite number becomes null.

    Only text that ends like a number is parsed at all: the JVM parser also takes suffixes such as
    ``1d`` and words such as ``NaN``, and a failing parse is slow. So is stripping: it is left to
    text that does not end like a number as it is.
    """

    def ends_like_one(value: Column) -> Column:
        return F.substring(value, -1, 1).isin(*"0123456789.")

    return F.when(ends_like_one(c) | ends_like_one(text.strip(c)), c.try_cast("double"))


def column_to_number(df: DataFrame, name: str) -> Column:
    """:func:`to_number` of a column of any type; doubles are not made text and parsed again."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, DoubleType):
        return F.when(F.abs(c) < float("inf"), c)  # NaN is above it
    return to_number(c.cast("string"))


def round_half_even(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def floor_percent(ratio: Column) -> Column:
    """Floor a ratio to three decimals and make it a percentage, in doubles and in this order.

    The result is compared with another rate, so the operations must not be merged.
    """
    return F.floor(ratio * 1000.0).cast("double") / 1000.0 * 100.0


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; a zero denominator gives null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))
