"""The area layer table ``(level, geoid, name, abbr, geometry)`` and the names it gives to results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual import constants as K


def check_level(level: str) -> str:
    if level not in K.LEVELS:
        raise ValueError(f"Level must be one of {K.LEVELS}, not {level!r}")
    return level


def layer(areas: DataFrame, level: str) -> DataFrame:
    """One level of the table with ``<level>_id_fips``, ``<level>_name`` and ``area_geometry``."""
    columns = [F.col("geoid").alias(f"{level}_id_fips"), F.col("name").alias(f"{level}_name")]
    if level == "state":
        columns.append(F.col("abbr").alias("state_abbr"))
    return areas.where(F.col("level") == level).select(*columns, F.col("geometry").alias("area_geometry"))


def state_names(areas: DataFrame) -> DataFrame:
    return layer(areas, "state").drop("area_geometry")


def county_names(areas: DataFrame) -> DataFrame:
    return layer(areas, "county").drop("area_geometry")


def add_area_info(
    df: DataFrame, fips_column: str, states: DataFrame | None = None, counties: DataFrame | None = None
) -> DataFrame:
    """Add state and county names by id; ids that are absent are the leading digits of ``fips_column``.

    The name tables hold one short row per area, so the planner broadcasts them while they are
    under its size limit and shuffles beyond it.
    """
    if states is not None:
        df = df.drop("state_name", "state_abbr")
        if "state_id_fips" not in df.columns:
            df = df.withColumn("state_id_fips", F.substring(fips_column, 1, 2))
        df = df.join(states.select("state_id_fips", "state_name", "state_abbr"), "state_id_fips", "left")
    if counties is not None:
        df = df.drop("county_name")
        if "county_id_fips" not in df.columns:
            df = df.withColumn("county_id_fips", F.substring(fips_column, 1, 5))
        df = df.join(counties.select("county_id_fips", "county_name"), "county_id_fips", "left")
    return df


def add_geometry(df: DataFrame, layer_df: DataFrame, id_column: str, add_name: bool = False) -> DataFrame:
    """Attach polygons last, so that they do not travel through earlier shuffles."""
    name = [id_column.replace("_id_fips", "_name")] if add_name else []
    return df.join(layer_df.select(id_column, *name, "area_geometry"), id_column, "left")
