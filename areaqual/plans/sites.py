"""Site tables: closed coal mines, retired coal generators and brownfields, with the area they lie in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaqual import constants as K
from areaqual.functions import geometry as geo
from areaqual.functions import numeric, predicates, text
from areaqual.operators import columns, dedupe
from areaqual.operators.quadtree import AreaIndex
from areaqual.operators.spatial import intersect_join
from areaqual.sources.sinks import Store, keep


def _known_places(df: DataFrame) -> DataFrame:
    """Rows with both coordinates, in range, as doubles."""
    df = df.withColumns({c: numeric.column_to_number(df, c) for c in ("latitude", "longitude")})
    return df.where(predicates.known_lat_lon(F.col("latitude"), F.col("longitude")))


def locate_sites(
    df: DataFrame, layer: DataFrame, level: str, qualifying_area: str, criteria: str,
    index: AreaIndex | None = None, store: Store = keep,
) -> DataFrame:
    """Add the areas each site intersects, its point and its labels.

    The cleaned sites are used for measuring hot cells, for the cell join and for the join back. With
    ``store`` they are written first, so the raw table is read and cleaned once.
    """
    df = store(df, f"{criteria}-sites")
    located = intersect_join(
        df, layer, f"{level}_id_fips", keep=[f"{level}_name"], geometry="area_geometry", index=index, store=store,
    )
    return located.withColumns(
        {
            "site_geometry": geo.point(F.col("longitude"), F.col("latitude")),
            "qualifying_area": F.lit(qualifying_area),
            "qualifying_criteria": F.lit(criteria),
        }
    )


MINE_TYPES = {"mine_id": "bigint", "current_status_dt": "date_us"}


def mine_headers(raw: DataFrame) -> DataFrame:
    return columns.normalise_headers(raw, trim=False, underscore=False)


def closed_mines(raw: DataFrame) -> DataFrame:
    """Coal mines closed since the first year of the rule, cleaned."""
    df = columns.cast_columns(mine_headers(raw), MINE_TYPES)
    df = columns.strip_lower_columns(df, ["current_mine_status", "coal_metal_ind", "current_mine_type"])
    df = df.where(
        predicates.closed_coal_mine(
            F.col("current_mine_status"), F.col("current_mine_type"), F.col("coal_metal_ind"),
            F.col("current_status_dt"),
        )
    )
    return _known_places(df).withColumns(
        {
            "current_mine_name": text.strip_title(F.col("current_mine_name")),
            "fips_cnty_cd": text.zero_fill(F.col("fips_cnty_cd").cast("string"), 3),
        }
    )


def clean_mines(raw: DataFrame, layer: DataFrame, level: str = "tract", **spatial) -> DataFrame:
    return locate_sites(closed_mines(raw), layer, level, level, K.MINE, **spatial)


def coal_generators(raw: DataFrame, planned: bool = False, as_of: str | None = None) -> DataFrame:
    """Retired coal generators (or those with a retirement planned after ``as_of``), latest report each."""
    coal = predicates.coal_generator(
        F.col("report_date"), F.col("energy_source_code_1"), F.col("technology_description")
    )
    if planned:
        if as_of is None:
            raise ValueError("Planned retirements need an as_of date")
        state: Column = predicates.retirement_planned(F.col("planned_generator_retirement_date"), as_of)
    else:
        state = predicates.retired(F.col("operational_status"))
    df = raw.where(state & coal).withColumns(
        {c: numeric.nan_to_null(F.col(c).try_cast("double")) for c in ("latitude", "longitude")}
    )
    df = df.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    unit = ["plant_id_eia", "utility_id_eia", "generator_id"]
    rest = [c for c in sorted(df.columns) if c not in {*unit, "report_date"}]
    return dedupe.keep_latest(df, unit, "report_date", rest)


def clean_generators(
    raw: DataFrame, layer: DataFrame, level: str = "tract", planned: bool = False, as_of: str | None = None, **spatial
) -> DataFrame:
    return locate_sites(coal_generators(raw, planned, as_of), layer, level, level, K.PLANT, **spatial)


def brownfield_sites(raw: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Sites outside the excluded programme, one per name and place.

    Between repeated sites the first by ``order`` stays (by default all other columns in turn).
    """
    df = columns.normalise_headers(raw, trim=False)
    df = df.withColumn("program", F.lower("program")).where(
        predicates.differs_or_unknown(F.col("program"), K.EXCLUDED_PROGRAM)
    )
    df = columns.rename_present(df, {"acreage_(acres)": "brownfield_acreage"})
    df = df.withColumns(
        {
            "site_name": text.strip_title(F.col("site_name").cast("string")),
            "state": F.col("state").cast("string"),
            "brownfield_acreage": numeric.column_to_number(df, "brownfield_acreage"),
        }
    )
    key = ["site_name", "latitude", "longitude"]
    order = order or [c for c in sorted(df.columns) if c not in key]
    return dedupe.keep_first(_known_places(df), key, order)


def clean_brownfields(raw: DataFrame, layer: DataFrame, level: str = "county", **spatial) -> DataFrame:
    return locate_sites(brownfield_sites(raw), layer, level, "point", K.BROWNFIELD, **spatial)
