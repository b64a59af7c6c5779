"""The raw inputs of the rules, derived from the driver tables with plain arithmetic.

region = state, nation = county (a 10 x 10 square), supplier = tract (a 3 x 3 square), orders =
mines and monthly series, lineitem = generators and employment facts, customer = brownfields.
Coordinates are small whole or half numbers, so borders, corners and outside points all occur.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaqual.functions import geometry as geo
from areaqual.operators import quadtree
from areaqual.operators.adjacency import adjacency
from areaqual.sources import sinks

GRID_COLUMNS = 5
COUNTY_SIDE = 10
TRACT_COLUMNS = 16
TRACT_SIDE = 3


_once: dict[tuple, Any] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Any]) -> Any:
    """What a deployment prepares once per layer or table, prepared once per session."""
    key = (spark.sparkContext.applicationId, spark.sparkContext.startTime, sf_dir, name)
    if key not in _once:
        _once[key] = make()
    return _once[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return once(spark, sf_dir, name, lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _e(sql: str, name: str):
    return F.expr(sql).alias(name)


COUNTY_ID = "concat(lpad(n_regionkey, 2, '0'), lpad(n_nationkey, 3, '0'))"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        _e("lpad(r_regionkey, 2, '0')", "state_id_fips"), F.col("r_name").alias("state_name"),
        _e("left(r_name, 2)", "state_abbr"),
    )


def _square(x: str, y: str, side: float):
    x0, y0 = F.expr(x).cast("double"), F.expr(y).cast("double")
    return geo.polygon(geo.rectangle_ring(x0, y0, x0 + side, y0 + side))


def county_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = _square(
        f"n_nationkey % {GRID_COLUMNS} * {COUNTY_SIDE}", f"n_nationkey div {GRID_COLUMNS} * {COUNTY_SIDE}", COUNTY_SIDE
    )
    return table(spark, sf_dir, "nation").select(
        _e(COUNTY_ID, "county_id_fips"), F.col("n_name").alias("county_name"), square.alias("area_geometry")
    )


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return county_layer(spark, sf_dir).drop("area_geometry")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


def tract_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = _square(
        f"s_suppkey % {TRACT_COLUMNS} * {TRACT_SIDE}", f"s_suppkey div {TRACT_COLUMNS} * {TRACT_SIDE}", TRACT_SIDE
    )
    return _suppliers(spark, sf_dir).select(
        _e(f"concat({COUNTY_ID}, lpad(s_suppkey, greatest(6, length(string(s_suppkey))), '0'))", "tract_id_fips"),
        _e("concat('Tract ', s_suppkey)", "tract_name"),
        square.alias("area_geometry"),
    )


def shaped_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier a square, an L or a square with a hole, in the same 3 x 3 places."""
    x = F.expr(f"s_suppkey % {TRACT_COLUMNS} * {TRACT_SIDE}").cast("double")
    y = F.expr(f"s_suppkey div {TRACT_COLUMNS} * {TRACT_SIDE}").cast("double")
    full = geo.rectangle_ring(x, y, x + 3, y + 3)
    ell = geo.ring((x, y), (x + 3, y), (x + 3, y + 1), (x + 1, y + 1), (x + 1, y + 3), (x, y + 3))
    hole = geo.rectangle_ring(x + 1, y + 1, x + 2, y + 2)
    kind = F.expr("s_suppkey % 3")
    shape = F.when(kind == 0, geo.polygon(full)).when(kind == 1, geo.polygon(ell)).otherwise(geo.polygon(full, hole))
    shapes = table(spark, sf_dir, "supplier").select("s_suppkey", shape.alias("raw"))
    return shapes.select("s_suppkey", geo.normalise("raw").alias("geometry"))


TEETH = 2000


def saw_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation an area of thousands of vertices: a strip whose upper border goes up and down by one at every step."""
    y = "n_nationkey * 10D"
    upper = f"transform(sequence({TEETH}, 0, -1), k -> named_struct('x', double(k), 'y', {y} + 5 + k % 2))"
    corners = f"array(named_struct('x', 0D, 'y', {y}), named_struct('x', {float(TEETH)}D, 'y', {y}))"
    ring = f"concat({corners}, {upper}, array(named_struct('x', 0D, 'y', {y})))"
    return table(spark, sf_dir, "nation").select("n_nationkey", F.expr(f"array(array({ring}))").alias("geometry"))


def place(key: str, shift: float = 0.0) -> tuple[str, str]:
    """Longitude and latitude of a key, as SQL."""
    return (
        f"CAST({key} * 7919 % 56 - 3 + {shift} AS DOUBLE)",
        f"CAST({key} * 104729 % 55 - 2 + {shift} AS DOUBLE)",
    )


def mines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = place("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        _e("string(o_orderkey)", "MINE_ID"),
        _e("concat('  o''hara-', o_orderkey, ' ', upper(o_orderpriority), '\t')", "CURRENT_MINE_NAME"),
        _e("CASE o_orderstatus WHEN 'F' THEN 'Abandoned ' WHEN 'P' THEN ' Abandoned and Sealed' ELSE 'Active' END",
           "CURRENT_MINE_STATUS"),
        _e("CASE o_orderpriority WHEN '1-URGENT' THEN 'Surface' WHEN '2-HIGH' THEN 'Underground' ELSE 'Facility' END",
           "CURRENT_MINE_TYPE"),
        _e("if(o_custkey % 3 = 0, 'M', 'C')", "COAL_METAL_IND"),
        _e("string(o_custkey % 1000)", "FIPS_CNTY_CD"),
        _e("if(o_orderkey % 211 = 0, 'unknown', date_format(o_orderdate, 'MM/dd/yyyy'))", "CURRENT_STATUS_DT"),
        _e(f"CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN '95.5' ELSE string({y}) END",
           "LATITUDE"),
        _e(f"string({x})", "LONGITUDE"),
    )


def generators_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = place("l_suppkey", 0.5)
    return table(spark, sf_dir, "lineitem").select(
        _e("l_shipdate + INTERVAL 15 YEARS", "report_date"),
        _e("CASE l_returnflag WHEN 'A' THEN 'BIT' WHEN 'R' THEN 'SUB' ELSE 'NG' END", "energy_source_code_1"),
        _e("""CASE l_linenumber % 3 WHEN 0 THEN 'Conventional Steam Coal' WHEN 1 THEN 'Natural Gas Fired'
              ELSE 'Coal Integrated Gasification Combined Cycle' END""", "technology_description"),
        _e("if(l_linestatus = 'F', 'retired', 'existing')", "operational_status"),
        _e("l_shipdate + INTERVAL 20 YEARS", "planned_generator_retirement_date"),
        _e(f"if(l_suppkey % 37 = 0, NULL, {x})", "longitude"),
        _e(y, "latitude"),
        F.col("l_suppkey").alias("plant_id_eia"),
        _e("l_partkey % 5", "utility_id_eia"),
        _e("concat('G', l_linenumber)", "generator_id"),
        _e("concat('Plant ', l_suppkey)", "plant_name_eia"),
    )


def brownfields_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread over the cluster at once, as the job does: a short file is read by one task, and cleaning is much work."""
    x, y = place("(c_custkey - c_custkey % 2)")
    return table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism).select(
        _e("concat(' old mill-', c_custkey - c_custkey % 2, ' SITE ')", "Site Name"),
        _e("concat('S', c_nationkey)", "State"),
        _e("CASE c_mktsegment WHEN 'BUILDING' THEN 'Superfund' WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END",
           "Program"),
        _e(f"if(c_custkey % 97 = 0, NULL, {y})", "Latitude"),
        _e(f"if(c_custkey % 89 = 0, 181D, {x})", "Longitude"),
        _e("if(c_custkey % 5 = 0, NULL, abs(c_acctbal))", "Acreage (acres)"),
        _e("lpad(c_custkey % 100000, 5, '0')", "Zip Code"),
    )


def facts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    supplier = _suppliers(spark, sf_dir).select("s_suppkey", "n_regionkey", "n_nationkey", "n_name")
    code = """CASE WHEN p_size = 1 AND p_type = 'ECONOMY' THEN '211' WHEN p_size = 2 AND p_type = 'STANDARD' THEN '2121'
                   WHEN p_size = 3 AND p_type = 'STANDARD' THEN '22112' WHEN p_size > 25 THEN '10' ELSE '541' END"""
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_quantity", "l_shipdate")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            _e("string(n_regionkey * 1000 + n_nationkey)", "Area FIPS"),
            _e("if(l_linenumber = 7, concat(n_name, ' MSA'), n_name)", "Area Title"),
            _e("year(l_shipdate)", "Year"),
            _e(code, "Industry Code"),
            _e("if(l_linestatus = 'O', 0, 5)", "Own Code"),
            _e("CAST(l_quantity - 1 AS BIGINT) * if(p_size > 25, 10, 1)", "Annual Avg Emplvl"),
        )
    )


def metro_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        _e("string(n_regionkey * 1000 + n_nationkey)", "County Code"),
        _e("concat('C', lpad(n_regionkey * 100 + 18, 4, '0'))", "MSA Code"),
        _e("concat('Metro area ', n_regionkey)", "MSA Title"),
        F.col("n_name").alias("County Title"),
        _e("CASE n_nationkey % 3 WHEN 0 THEN 'Metro' WHEN 1 THEN 'Micro' ELSE 'None' END", "MSA Type"),
    )


def non_metro_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per supplier, so every county is listed many times and some are split in two."""
    return _suppliers(spark, sf_dir).select(
        _e("n_regionkey", "FIPS code"),
        _e("n_nationkey", "County code"),
        _e("s_suppkey % 1000", "Township code"),
        _e("if(n_nationkey % 7 = 0, 'City area', concat('Region ', n_regionkey, ' nonmetropolitan area'))",
           "May 2023 MSA name"),
        _e("string(100000 + n_regionkey * 2 + s_suppkey % 2)", "May 2023 MSA code"),
        F.col("n_name").alias("County name"),
    )


def unemployment_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    located = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    measure = "CASE o_orderstatus WHEN 'F' THEN '04' WHEN 'O' THEN '06' ELSE '03' END"
    value = """CASE WHEN o_orderkey % 53 = 0 THEN '-' WHEN o_orderstatus = 'F' THEN string(CAST(o_totalprice AS BIGINT) % 1000)
                    ELSE concat('  ', 10500 + CAST(o_totalprice AS BIGINT) % 1000) END"""
    return (
        table(spark, sf_dir, "orders")
        .join(located, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            _e(f"concat('LAUCN', {COUNTY_ID}, '00000000', {measure}, '  ')", "series_id   "),
            _e("string(year(o_orderdate))", "year"),
            _e("if(o_orderkey % 59 = 0, 'M13', date_format(o_orderdate, \"'M'MM\"))", "period"),
            _e(value, "       value"),
        )
    )


def national_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        _e("string(year(o_orderdate))", "year"),
        _e("if(o_orderkey % 61 = 0, 'M13', date_format(o_orderdate, \"'M'MM\"))", "period"),
        _e("date_format(o_orderdate, 'MMMM')", "periodName"),
        _e("string(o_orderkey % 10)", "value"),
        F.lit(" LNS14000000 ").alias("series_id"),
    )


def layer(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    return county_layer(spark, sf_dir) if level == "county" else tract_layer(spark, sf_dir)


def square_adjacency(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """Edge table of a layer, built by the adjacency operator."""
    return adjacency(
        layer(spark, sf_dir, level), f"{level}_id_fips", "area_geometry", store=sinks.write_and_reuse,
        index=layer_index(spark, sf_dir, level),
    )


def stored_adjacency(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """The edge table as the rules use it: built once and read from where it is stored."""

    def build() -> DataFrame:
        return sinks.write_table(
            square_adjacency(spark, sf_dir, level), sinks.scratch_folder(spark, f"adjacency-{level}")
        )

    return once(spark, sf_dir, f"adjacency {level}", build)


def layer_index(spark: SparkSession, sf_dir: str, level: str) -> quadtree.AreaIndex:
    """The stored index of a layer."""
    return once(spark, sf_dir, f"index {level}", lambda: quadtree.build_index(
        layer(spark, sf_dir, level), f"{level}_id_fips", "area_geometry", sinks.write_and_reuse
    ))
