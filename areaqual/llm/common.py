"""Helpers shared by the operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaqual.sources.sinks import scratch_folder

#: Words are runs of anything but these bytes; for the regular expressions of Spark and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send the functions of a module with the tasks, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and go on from the copy: lost executors then cost a read, not a second run."""
    path = scratch_folder(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table holds."""
    return df.select(*[col(df, n) for n in names])


def col(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`")


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def repeated(df: DataFrame, n: str, number: str, step: int = 1 << 14, counts: DataFrame | None = None) -> DataFrame:
    """Every row as often as its column ``n`` says, numbered from 1 in ``number``.

    A row that is wanted more than ``step`` times is cut into stretches of that length, which are dealt to all tasks before
    they are spread out, so no array is longer than ``step`` or n / ``step``. ``counts`` is a table with the same ``n``, if
    one is cheaper to look through for such rows; ``df`` is computed twice where there are any.
    """
    df = df.filter(F.col(n) > 0)
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))
    if (df if counts is None else counts).filter(F.col(n) > step).isEmpty():
        return df.withColumn(number, one)
    few, many = df.filter(F.col(n) <= step).withColumn(number, one), df.filter(F.col(n) > step)
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / step)))
    dealt = many.withColumn("__stretch", stretch).repartition(F.col("__stretch"))
    begin = F.col("__stretch") * step
    spread = F.explode(F.sequence(begin + 1, F.least(begin + step, F.col(n))))
    return few.unionByName(dealt.withColumn(number, spread).drop("__stretch"))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores behind it as it takes to be none of those taken."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
