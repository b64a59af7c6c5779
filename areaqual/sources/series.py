"""Replies of the statistics service: JSON documents with nested series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaqual import constants as K

REPLY_DDL = """
    status string,
    Results struct<series: array<struct<
        seriesID: string,
        data: array<struct<year: string, period: string, periodName: string, value: string>>>>>
"""


def read_replies(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """One row per document: a document per file, or per line when ``multi_line`` is off."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(REPLY_DDL).json(paths, multiLine=multi_line)


def flatten_replies(replies: DataFrame) -> DataFrame:
    """One row per series and period; a reply without success stops the run."""
    series = F.when(F.col("status") == K.NATIONAL_STATUS_OK, F.col("Results.series")).otherwise(
        F.raise_error(F.concat(F.lit("The statistics service replied with status "), F.coalesce("status", F.lit("null"))))
    )
    one = replies.select(F.explode(series).alias("s")).select("s.seriesID", F.explode("s.data").alias("d"))
    return one.select("d.year", "d.period", "d.periodName", "d.value", F.col("seriesID").alias("series_id"))


def read_national_rates(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return flatten_replies(read_replies(spark, paths))
