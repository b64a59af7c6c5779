"""Values that a cast cannot keep: counted, set aside in a table of their own, or the end of the run.

A table is read once: its rows are stored with a mark for every value that does not fit its type, and are counted on
the way (``DataFrame.observe``). What goes on and what is set aside is read from the stored copy.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual.operators.columns import typed
from areaqual.operators.quality import DataCheckError, observe_counts
from areaqual.sources.sinks import Store, keep, write_and_reuse

log = logging.getLogger(__name__)

MODES = ("fail", "warn", "keep")
_MARKS = "_aq_rejects"


@dataclass(frozen=True)
class Policy:
    """``fail`` stops the run; ``warn`` sets rows with such a value aside and goes on without them; ``keep`` goes on with
    every row, the value being null. ``quarantine`` is the folder of the rejected values (source, column, raw, record),
    written under ``fail`` and ``warn``."""

    mode: str = "keep"
    quarantine: str | None = None
    store: Store = write_and_reuse

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"Rejects are one of {MODES}, not {self.mode!r}")


KEEP = Policy("keep", store=keep)


def marked(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``df`` and, in one more column, the name and raw value of everything that does not fit its type."""
    found = [
        F.when(F.col(c).isNotNull() & typed(df, c, t).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw")))
        for c, t in types.items()
    ]
    return df.withColumn(_MARKS, F.array_compact(F.array(*found)))


def listed(marks: DataFrame, source: str) -> DataFrame:
    """``source, column, raw, record``: a row for every rejected value, with its whole row as JSON."""
    record = F.to_json(F.struct(*[c for c in marks.columns if c != _MARKS]))
    bad = marks.where(F.size(_MARKS) > 0).select(F.lit(source).alias("source"), F.inline(_MARKS), record.alias("record"))
    return bad.select("source", "column", "raw", "record")


def rejected_values(df: DataFrame, types: Mapping[str, str], source: str) -> DataFrame:
    """:func:`listed` for a table as it is read."""
    return listed(marked(df, types), source)


def checked(df: DataFrame, types: Mapping[str, str], source: str, policy: Policy = KEEP) -> DataFrame:
    """The rows that go on, untyped as before. Under ``keep`` nothing is read here; else the table is read once, now."""
    if policy.mode == "keep":
        return df
    seen, counts = observe_counts(marked(df, types), f"{source}-rejects", {"rows": F.lit(True), "bad": F.size(_MARKS) > 0})
    stored = policy.store(seen, f"{source}-checked")
    numbers = counts.get
    if numbers["bad"]:
        bad = listed(stored, source)
        if policy.quarantine:
            bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(policy.quarantine)
        sample = [tuple(r) for r in bad.select("column", "raw").distinct().limit(5).collect()]
        text = f"{numbers['bad']} of {numbers['rows']} rows of {source} hold values that do not fit, for example {sample}"
        if policy.mode == "fail":
            raise DataCheckError(text)
        log.warning(text)
    return stored.where(F.size(_MARKS) == 0).drop(_MARKS)
