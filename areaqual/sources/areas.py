"""Area layers: one Parquet table partitioned by level, loaded from line-delimited GeoJSON.

The coordinate system stands in the metadata of the geometry column. It is written with the table and
demanded when it is read, so shapes in another system never meet the sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaqual import constants as K
from areaqual.functions import geometry as geo
from areaqual.operators.quality import DataCheckError, fail_when

_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def parse_geojson_geometry(text: str) -> str:
    """SQL for a geometry from GeoJSON text; polygons become one-element lists."""
    kind = f"get_json_object({text}, '$.type')"
    coordinates = f"get_json_object({text}, '$.coordinates')"
    listed = f"""
        CASE {kind}
          WHEN 'Polygon' THEN array(from_json({coordinates}, '{_POLYGON}'))
          WHEN 'MultiPolygon' THEN from_json({coordinates}, '{_MULTI}') END"""
    return f"""
        transform({listed}, poly -> transform(poly, r -> transform(r,
          p -> named_struct('x', p[0], 'y', p[1]))))"""


def read_geojson_lines(
    spark: SparkSession, paths: str, level: str, geoid: str = "GEOID10", name: str = "NAMELSAD10", abbr: str | None = None,
    crs: str = K.GEOGRAPHIC_CRS,
) -> DataFrame:
    """Features, one per line, as rows of the area table.

    One feature per line keeps the file splittable; a single document with all features would be
    read by one task. A feature that names a coordinate system other than ``crs`` stops the run; there is no reprojection.
    """
    named = F.get_json_object("value", "$.crs.properties.name")
    authority, code = crs.split(":")
    other = named.isNotNull() & ~F.upper(named).rlike(rf"(^|:){authority}:+{code}$")
    features = spark.read.text(paths).where("trim(value) != ''").select(
        fail_when(other, f"The layer is not in {crs}", F.get_json_object("value", f"$.properties.{geoid}")).alias("geoid"),
        F.get_json_object("value", f"$.properties.{name}").alias("name"),
        (F.get_json_object("value", f"$.properties.{abbr}") if abbr else F.lit(None).cast("string")).alias("abbr"),
        F.get_json_object("value", "$.geometry").alias("shape"),
    )
    parsed = features.withColumn("geometry", F.expr(parse_geojson_geometry("shape")))
    return in_crs(
        parsed.select(F.lit(level).alias("level"), "geoid", "name", "abbr", geo.normalise("geometry").alias("geometry")), crs
    )


def in_crs(areas: DataFrame, crs: str, geometry: str = "geometry") -> DataFrame:
    """The same rows, with the coordinate system in the metadata of the geometry column."""
    return areas.withMetadata(geometry, areas.schema[geometry].metadata | {"crs": crs})


def crs_of(areas: DataFrame, geometry: str = "geometry") -> str | None:
    return areas.schema[geometry].metadata.get("crs")


def require_crs(areas: DataFrame, crs: str = K.GEOGRAPHIC_CRS, geometry: str = "geometry") -> DataFrame:
    """The same table, or an error if its shapes are in another coordinate system or none is named. Reads no rows."""
    found = crs_of(areas, geometry)
    if found != crs:
        raise DataCheckError(f"The areas are in {found or 'a coordinate system that is not named'}, expected {crs}")
    return areas


def write_areas(areas: DataFrame, path: str) -> None:
    """Replace the levels of ``areas``; their coordinate system must be named (:func:`in_crs`) and the rules' own."""
    checked = require_crs(areas)
    checked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level").parquet(path)


def read_areas(spark: SparkSession, path: str, crs: str = K.GEOGRAPHIC_CRS) -> DataFrame:
    """The table; a filter on ``level`` prunes to one directory. It must be in ``crs``; there is no reprojection."""
    return require_crs(spark.read.parquet(path), crs).select("level", "geoid", "name", "abbr", "geometry")
