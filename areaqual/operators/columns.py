"""Header cleaning, typed casts and reject tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from areaqual.functions import text


def normalise_headers(df: DataFrame, trim: bool = True, underscore: bool = True) -> DataFrame:
    """Lower-case headers, optionally trim them and turn blanks into underscores."""

    def clean(name: str) -> str:
        name = (name.strip() if trim else name).lower()
        return name.replace(" ", "_") if underscore else name

    return df.toDF(*[clean(c) for c in df.columns])


def locate_columns(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Rename the first header that contains each key to its value; publishers date their headers."""
    renames = {}
    for part, name in wanted.items():
        hits = [c for c in df.columns if part in c]
        if not hits:
            raise ValueError(f"No column name contains {part!r}: {df.columns}")
        renames[hits[0]] = name
    return df.withColumnsRenamed(renames)


def rename_present(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename columns; an old column that already has the new name gives way."""
    stale = [new for old, new in renames.items() if old != new and old in df.columns and new in df.columns]
    return df.drop(*stale).withColumnsRenamed(dict(renames))


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns; a value that does not fit becomes null (see :func:`rejects`)."""
    return df.withColumns({c: typed(df, c, t) for c, t in types.items()})


def rejects(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Rows with a value that :func:`cast_columns` cannot keep, and the names of those columns."""
    bad = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull() & typed(df, c, t).isNull(), F.lit(c)) for c, t in types.items()])
    )
    return df.withColumn("rejected_columns", bad).where(F.size("rejected_columns") > 0)


def typed(df: DataFrame, name: str, type_name: str) -> Column:
    """The value as that type, or null where it does not fit."""
    value = F.col(name)
    if type_name == "date_us":
        return F.try_to_timestamp(value, F.lit("M/d/yyyy"))
    typed = value.try_cast(type_name)
    if type_name in ("int", "bigint") and isinstance(df.schema[name].dataType, StringType):
        # Integers may arrive as ``12.0`` when another tool wrote the file; only those are redone.
        return F.coalesce(typed, F.regexp_replace(value, r"\.0+$", "").try_cast(type_name))
    return typed


def strip_lower_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({c: text.strip_lower(F.col(c)) for c in names})
