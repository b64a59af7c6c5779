"""The coal closure and brownfield rules: one row per site and area, and per neighbouring area."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual import constants as K
from areaqual.plans.layers import add_area_info, add_geometry

# The header of the result and its order, in two parts as the site part is also selected alone.
_SITE = ["site_name", "qualifying_criteria", "qualifying_area", "latitude", "longitude", "site_geometry"]
_AREA = ["county_name", "county_id_fips", "state_id_fips", "state_abbr", "state_name", "geoid"]


def result_columns(level: str) -> list[str]:
    return (["tract_name", "tract_id_fips"] if level == "tract" else []) + _AREA + _SITE


def adjacent_records(
    sites: DataFrame, adjacency: DataFrame, layer: DataFrame, level: str, closure: str
) -> DataFrame:
    """One row per area next to an area with a site.

    Ids are made distinct before and after the edge table, so shuffles carry one short row per area
    however many sites it has. An area without neighbours, or a site outside all areas, gives one
    row without an area. A neighbour that has a site of its own stays.
    """
    area_id = f"{level}_id_fips"
    primary = sites.select(area_id).distinct()
    neighbours = (
        primary.join(adjacency, area_id, "left").select(F.col(f"adjacent_{area_id}").alias(area_id)).distinct()
    )
    return neighbours.join(layer.select(area_id, f"{level}_name"), area_id, "left").withColumns(
        {"qualifying_area": F.lit(level), "qualifying_criteria": F.lit(f"{closure}_adjacent_{level}")}
    )


def _finish(df: DataFrame, level: str, states: DataFrame, counties: DataFrame, geometry: DataFrame | None) -> DataFrame:
    area_id = f"{level}_id_fips"
    df = df.withColumn("geoid", F.col(area_id))
    named = add_area_info(df, area_id, states, counties if level == "tract" else None)
    if geometry is None:
        return named.select(*result_columns(level))
    return add_geometry(named, geometry, area_id).select(*result_columns(level), "area_geometry")


def coal_rule(
    mines: DataFrame, generators: DataFrame, adjacency: DataFrame, layer: DataFrame,
    states: DataFrame, counties: DataFrame, level: str = "tract", with_geometry: bool = True,
) -> DataFrame:
    """Areas with a closed mine or retired generator, and the areas next to them."""
    area = [f"{level}_id_fips", f"{level}_name"]
    branches = [
        mines.withColumnRenamed("current_mine_name", "site_name").select(*area, *_SITE),
        generators.withColumnRenamed("plant_name_eia", "site_name").select(*area, *_SITE),
        adjacent_records(mines, adjacency, layer, level, K.MINE_CLOSURE),
        adjacent_records(generators, adjacency, layer, level, K.PLANT),
    ]
    combined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    return _finish(combined, level, states, counties, layer if with_geometry else None)


def brownfield_rule(
    brownfields: DataFrame, layer: DataFrame, states: DataFrame, counties: DataFrame,
    level: str = "tract", with_geometry: bool = True,
) -> DataFrame:
    """Brownfield sites with their area."""
    return _finish(
        brownfields.select(f"{level}_id_fips", f"{level}_name", *_SITE), level, states, counties,
        layer if with_geometry else None,
    )


def all_rules(*results: DataFrame) -> DataFrame:
    """All results under one header; columns a rule does not have are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
