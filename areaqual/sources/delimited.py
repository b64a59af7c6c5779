"""Delimited and columnar inputs. Text columns are read as strings and typed later, so that codes
keep their leading zeros and a bad value never stops a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATIN_1 = "ISO-8859-1"


def _csv(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.options(header=True, inferSchema=False, escape='"', **options).csv(paths)


def read_mines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Pipe-delimited Latin-1 text."""
    return _csv(spark, paths, sep="|", encoding=LATIN_1)


def read_unemployment(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tab-delimited period files, all appended; also the area and footnote tables."""
    return _csv(spark, paths, sep="\t")


read_unemployment_areas = read_unemployment
read_unemployment_footnotes = read_unemployment


def read_metro_crosswalk(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return _csv(spark, paths, encoding=LATIN_1)


def read_non_metro_definitions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Area, county and township codes; the first sheet of the workbook, landed as CSV."""
    return _csv(spark, paths)


def read_area_titles(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return _csv(spark, paths)


def read_brownfields(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """CSV, possibly gzipped. A gzip file is read by one task, so ``partitions`` spreads its rows."""
    df = _csv(spark, path, multiLine=False)
    return df.repartition(partitions) if partitions else df


def read_yearly_csv(spark: SparkSession, directory: str, years: Sequence[int] | None = None) -> DataFrame:
    """CSV files laid out as ``year=YYYY/``; only the wanted years are listed, missing years are empty."""
    df = _csv(spark, directory, enforceSchema=False)
    return df if years is None else df.where(F.col("year").isin([int(y) for y in years]))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A table in any format Spark has a reader for."""
    return spark.read.format(fmt).options(**options).load(path)


def read_generators(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The yearly generators table."""
    return read_table(spark, path, fmt, **options)


def read_facts(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """Employment facts stored by year; a year filter prunes partitions and missing years are empty."""
    df = spark.read.parquet(path)
    return df if years is None else df.where(F.col("year").isin([int(y) for y in years]))
