"""County to statistical area crosswalks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual.functions import text
from areaqual.operators import columns, dedupe, joins, quality

KEY = ["county_id_fips"]


def metro_crosswalk(raw: DataFrame) -> DataFrame:
    """Counties of metropolitan areas."""
    df = columns.normalise_headers(raw)
    df = columns.rename_present(
        df, {"county_code": "county_id_fips", "msa_title": "msa_name", "county_title": "county_name"}
    )
    df = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    return df.where(F.col("msa_type") == "Metro").withColumn(
        "county_id_fips", text.zero_fill(F.col("county_id_fips"), 5)
    )


def non_metro_crosswalk(raw: DataFrame, metro: DataFrame, order: Sequence[str] = ("msa_code", "msa_name")) -> DataFrame:
    """One nonmetropolitan area per county that has no part in a metropolitan area.

    A county split between several areas keeps the first by ``order``.
    """
    df = columns.normalise_headers(raw)
    df = columns.locate_columns(df, {"msa_name": "msa_name", "msa_code": "msa_code", "county_name": "county_name"})
    df = columns.rename_present(
        df, {"fips_code": "state_id_fips", "county_code": "county_id_fips", "township_code": "township_id_fips"}
    )
    df = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    df = df.where(F.col("msa_name").contains("nonmetropolitan")).withColumns(
        {
            "state_id_fips": text.zero_fill(F.col("state_id_fips"), 2),
            "county_id_fips": F.concat(
                text.zero_fill(F.col("state_id_fips"), 2), text.zero_fill(F.col("county_id_fips"), 3)
            ),
            "township_id_fips": text.zero_fill(F.col("township_id_fips"), 3),
        }
    )
    rest = [c for c in df.columns if c not in {*KEY, *order}]
    # One row per county before the join: a county with very many rows is cut down before any shuffle.
    return joins.without_keys(dedupe.keep_first(df, KEY, [*order, *rest]), metro, KEY)


def county_areas(metro: DataFrame, non_metro: DataFrame) -> DataFrame:
    """Both crosswalks as one table: ``county_id_fips, msa_code, msa_name``."""
    wanted = ["county_id_fips", "msa_code", "msa_name"]
    return metro.select(*wanted).unionByName(non_metro.select(*wanted))


def checked_county_areas(metro: DataFrame, non_metro: DataFrame) -> DataFrame:
    """:func:`county_areas` that fails when a county belongs to two areas."""
    return quality.require_unique(county_areas(metro, non_metro), KEY, "A county is in more than one statistical area")
