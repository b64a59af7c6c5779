"""Site cleaning, coal and brownfield rules, features and reports."""

import datetime
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from areaqual.functions import geometry as geo
from areaqual.functions import numeric, predicates
from areaqual.operators import adjacency as adj
from areaqual.operators import aggregates, columns, dedupe, sums
from areaqual.plans import coal, layers, report, sites
from tests import shapes
from workload import tables
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def areas(spark):
    """Two states, four counties of 4 x 4, sixteen tracts of 2 x 2."""
    rows = [("state", "01", "Alpha", "AL", None), ("state", "02", "Beta", "BE", None)]
    for k, (x, y) in enumerate([(0, 0), (4, 0), (0, 4), (4, 4)]):
        county = f"0{k // 2 + 1}00{k % 2 + 1}"
        square = [([(x, y), (x + 4, y), (x + 4, y + 4), (x, y + 4)], [])]
        rows.append(("county", county, f"County {k}", None, shapes.geometry(square)))
        for t, (u, v) in enumerate([(0, 0), (2, 0), (0, 2), (2, 2)]):
            box = [([(x + u, y + v), (x + u + 2, y + v), (x + u + 2, y + v + 2), (x + u, y + v + 2)], [])]
            rows.append(("tract", f"{county}00000{t}", f"Tract {k}.{t}", None, shapes.geometry(box)))
    df = spark.createDataFrame(rows, "level string, geoid string, name string, abbr string, raw " + geo.GEOMETRY_DDL)
    return df.select("level", "geoid", "name", "abbr", geo.normalise("raw").alias("geometry"))


@pytest.fixture(scope="module")
def tracts(areas):
    return layers.layer(areas, "tract")


@pytest.fixture(scope="module")
def edges(tracts):
    return adj.adjacency(tracts, "tract_id_fips", "area_geometry")


MINES = [
    (1, " o'neil MINE ", "Abandoned ", "Surface", "C", "7", "01/15/2000", "1.0", "1.0"),
    (2, "sealed", "Abandoned and Sealed", "underground", "c", "007", "12/31/2010", "2.0", "1.0"),  # on a border
    (3, "old", "Abandoned", "Surface", "C", "7", "12/31/1999", "1.0", "1.0"),
    (4, "active", "Active", "Surface", "C", "7", "01/15/2010", "1.0", "1.0"),
    (5, "metal", "Abandoned", "Surface", "M", "7", "01/15/2010", "1.0", "1.0"),
    (6, "facility", "Abandoned", "Facility", "C", "7", "01/15/2010", "1.0", "1.0"),
    (7, "no place", "Abandoned", "Surface", "C", "7", "01/15/2010", None, "1.0"),
    (8, "off the map", "Abandoned", "Surface", "C", "7", "01/15/2010", "1.0", "200.0"),
    (9, "bad date", "Abandoned", "Surface", "C", "7", "sometime", "1.0", "1.0"),
    (10, "outside", "Abandoned", "Surface", "C", "7", "01/15/2010", "50.0", "50.0"),
]


@pytest.fixture(scope="module")
def mines(spark, tracts):
    raw = spark.createDataFrame(
        [(str(r[0]), *r[1:]) for r in MINES],
        "MINE_ID string, CURRENT_MINE_NAME string, CURRENT_MINE_STATUS string, CURRENT_MINE_TYPE string, "
        "COAL_METAL_IND string, FIPS_CNTY_CD string, CURRENT_STATUS_DT string, LATITUDE string, LONGITUDE string")
    return sites.clean_mines(raw, tracts, "tract")


GENERATORS = [
    # plant, utility, generator, report, fuel, technology, status, planned, lon, lat
    (1, 1, "a", "2012-01-01", "BIT", None, "retired", None, 5.0, 5.0),
    (1, 1, "a", "2015-01-01", "BIT", "Conventional Steam Coal", "retired", None, 5.0, 5.0),
    (1, 1, "b", "2014-01-01", "BIT", "Natural Gas", "retired", None, 5.0, 5.0),
    (1, 1, "c", "2009-12-31", "BIT", "Conventional Steam Coal", "retired", None, 5.0, 5.0),
    (2, 1, "a", "2013-12-31", "NG", "Conventional Steam Coal", "retired", None, 5.0, 5.0),
    (2, 1, "b", "2013-12-31", "LIG", None, "retired", None, None, 5.0),
    (3, 1, "a", "2020-01-01", "SUB", "Conventional Steam Coal", "existing", "2030-01-01", 1.0, 1.0),
    (3, 1, "b", "2020-01-01", "SUB", "Conventional Steam Coal", "existing", "2021-01-01", 1.0, 1.0),
]


@pytest.fixture(scope="module")
def raw_generators(spark):
    day = lambda v: v and datetime.datetime.fromisoformat(v)
    rows = [(p, u, g, day(d), f, t, s, day(n), x, y, f"Plant {p}") for p, u, g, d, f, t, s, n, x, y in GENERATORS]
    return spark.createDataFrame(
        rows, "plant_id_eia int, utility_id_eia int, generator_id string, report_date timestamp, energy_source_code_1 string, "
              "technology_description string, operational_status string, planned_generator_retirement_date timestamp, "
              "longitude double, latitude double, plant_name_eia string")


@pytest.fixture(scope="module")
def generators(raw_generators, tracts):
    return sites.clean_generators(raw_generators, tracts, "tract")


def test_closed_mines(mines):
    got = {(r.mine_id, r.tract_id_fips) for r in mines.collect()}
    # Mine 2 lies on the border of two tracts, mine 10 outside all of them.
    assert got == {(1, "01001000000"), (2, "01001000000"), (2, "01001000002"), (10, None)}
    first = mines.where("mine_id = 1").first()
    assert (first.current_mine_name, first.fips_cnty_cd, first.qualifying_criteria, first.qualifying_area) == (
        "O'Neil Mine", "007", "coalmine", "tract")
    assert (first.site_geometry.x, first.site_geometry.y) == (1.0, 1.0)


def test_retired_generators(raw_generators, generators):
    assert [(r.plant_id_eia, r.generator_id, r.report_date.year, r.tract_id_fips) for r in generators.collect()] == [
        (1, "a", 2015, "02002000000")]
    planned = sites.coal_generators(raw_generators, planned=True, as_of="2025-01-01").collect()
    assert [(r.plant_id_eia, r.generator_id) for r in planned] == [(3, "a")]
    with pytest.raises(ValueError):
        sites.coal_generators(raw_generators, planned=True)


def test_brownfields(spark, areas):
    rows = [
        ("  river yard", "AA", "Brownfields", 1.0, 1.0, "10.5", "00501"), ("RIVER YARD ", "AA", "Brownfields", 1.0, 1.0, "3", "00501"),
        ("river yard", "AA", "SuperFund", 1.0, 2.0, "1", "00501"), ("kept", None, None, 4.0, 4.0, None, "00501"),
        ("nowhere", "AA", "x", None, 1.0, "1", "00501"), ("too far", "AA", "x", 91.0, 1.0, "1", "00501"),
    ]
    raw = spark.createDataFrame(rows, "`Site Name` string, State string, Program string, Latitude double, Longitude double, "
                                      "`Acreage (acres)` string, `Zip Code` string")
    got = sites.clean_brownfields(raw, layers.layer(areas, "county"), "county").collect()
    assert sorted((r.site_name, r.county_id_fips, r.brownfield_acreage) for r in got if r.site_name != "Kept") == [
        ("River Yard", "01001", 3.0)]  # first by the other columns, acreage to begin with
    ordered = sites.brownfield_sites(raw, order=[F.col("brownfield_acreage").desc()])
    assert ordered.where("site_name = 'River Yard'").first().brownfield_acreage == 10.5
    # A corner point belongs to all four counties.
    assert {r.county_id_fips for r in got if r.site_name == "Kept"} == {"01001", "01002", "02001", "02002"}


def test_coal_rule(areas, mines, generators, tracts, edges):
    df = coal.coal_rule(mines, generators, edges, tracts, layers.state_names(areas), layers.county_names(areas), "tract")
    rows = df.collect()
    assert df.columns[:2] == ["tract_name", "tract_id_fips"] and df.columns[-1] == "area_geometry"
    by = {}
    for r in rows:
        by.setdefault(r.qualifying_criteria, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {
        "coalmine": 4, "coal_plant": 1, "coal_mine_adjacent_tract": 7, "coal_plant_adjacent_tract": 8}
    near = {r.tract_id_fips for r in by["coal_mine_adjacent_tract"]}
    # Neighbours that have a mine themselves stay; the mine outside all tracts adds one empty row.
    assert near == {None, "01001000000", "01001000001", "01001000002", "01001000003", "02001000000", "02001000001"}
    one = by["coal_plant"][0]
    assert (one.county_name, one.county_id_fips, one.state_name, one.state_abbr, one.geoid, one.site_name) == (
        "County 3", "02002", "Beta", "BE", "02002000000", "Plant 1")
    assert one.area_geometry is not None and by["coal_plant_adjacent_tract"][0].site_name is None


def test_county_level(areas, raw_generators):
    counties = layers.layer(areas, "county")
    located = sites.clean_generators(raw_generators, counties, "county")
    edges = adj.adjacency(counties, "county_id_fips", "area_geometry")
    df = coal.coal_rule(located.limit(0).withColumn("current_mine_name", F.lit("x")), located, edges, counties,
                        layers.state_names(areas), layers.county_names(areas), "county", with_geometry=False)
    got = {(r.geoid, r.county_name, r.qualifying_criteria) for r in df.collect()}
    assert got == {("02002", "County 3", "coal_plant"), ("01001", "County 0", "coal_plant_adjacent_county"),
                   ("01002", "County 1", "coal_plant_adjacent_county"), ("02001", "County 2", "coal_plant_adjacent_county")}
    with pytest.raises(ValueError):
        layers.check_level("state")


def test_features(mines, generators, tracts, edges):
    a, b = (report.feature_table(df, edges, tracts, "tract") for df in (mines, generators))
    assert {r.geoid: r.primary_or_adj for r in a.collect()}["01001000000"] == "primary"
    assert "01001000001" in {r.geoid for r in a.where("primary_or_adj = 'adjacent'").collect()}
    both = {r.geoid: r for r in report.combine_features(a, b).collect()}
    assert both["02002000000"].primary_or_adj == "primary_gen" and both["02002000000"].geometry is not None
    # Next to a generator and to a mine: the mine label is the stronger one.
    assert both["01001000003"].primary_or_adj == "adjacent_mine"


def test_acreage(spark):
    rows = [("a", 1.0), ("a", None), ("b", 2.5), ("b", 9.0), ("c", None), (None, 3.0), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "county_id_fips string, brownfield_acreage double")
    got = {r[0]: tuple(r)[1:] for r in report.brownfield_acreage(df).collect()}
    mean, median = (1 + 2.5 + 9 + 3) / 4, 2.75
    assert got == {"a": (1.0, round(1 + 2 * mean, 2), 1 + 2 * median), "b": (11.5, 11.5, 11.5),
                   "c": (0.0, round(mean, 2), median)}


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 900 + [1.0, 9.0], list(range(1001)), [2.0] * 500 + [4.0] * 500,
                                    [float(i * i % 977) for i in range(2000)], [10.0**e for e in range(-150, 150)]])
def test_exact_median(spark, values):
    import statistics
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    assert aggregates.exact_median(df, "v", buckets=8).first()[0] == statistics.median(values)


def test_median_of_nothing(spark):
    assert aggregates.exact_median(spark.createDataFrame([(None,)], "v double"), "v").first()[0] is None


def test_county_report(spark, areas, tracts):
    rows = [("01001", "County 0", "Alpha", "01001000000", "coalmine"), ("01001", "County 0", "Alpha", "01001000000", "coalmine"),
            ("01001", "County 0", "Alpha", "01001000001", "coal_mine_adjacent_tract"),
            ("01001", "County 0", "Alpha", None, "fossil_fuel_employment"),
            ("01002", "County 1", "Alpha", "01002000000", "brownfield"), (None, None, None, None, "coal_plant_adjacent_tract")]
    df = spark.createDataFrame(rows, "county_id_fips string, county_name string, state_name string, tract_id_fips string, "
                                     "qualifying_criteria string")
    acreage = spark.createDataFrame([("01002", 1.0, 2.0, 3.0)], "county_id_fips string, brownfield_acreage double, "
                                    "brownfield_acreage_mean_fill double, brownfield_acreage_median_fill double")
    table = report.county_report(df, acreage, tracts, layers.layer(areas, "county"))
    got = {r.county_id_fips: r for r in table.collect()}
    # Half of the county; its place is far from the zone, so the projected share is a little off.
    half = pytest.approx(0.5, abs=0.06)
    assert tuple(got["01001"]) == ("01001", "County 0", "Alpha", 0, 0.0, 0.0, 0.0, 2, half, True)
    assert tuple(got["01002"]) == ("01002", "County 1", "Alpha", 1, 1.0, 2.0, 3.0, 0, 0.0, False)
    assert report.oversized_shares(table).count() == 0


def test_header_tools(spark):
    df = spark.createDataFrame([(1, 2)], "` A b ` int, `C` int")
    assert columns.normalise_headers(df).columns == ["a_b", "c"]
    assert columns.normalise_headers(df, trim=False, underscore=False).columns == [" a b ", "c"]
    bad = columns.rejects(spark.createDataFrame([("1", "x"), ("2.0", "3"), (None, None)], "a string, b string"), {"a": "int", "b": "int"})
    assert [(r.a, r.rejected_columns) for r in bad.collect()] == [("1", ["b"])]


def test_deduplication_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).select(F.expr("id % 7").alias("k"), F.col("id").alias("v"))
    kept = dedupe.keep_first(df, ["k"], [F.col("v").desc()])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    partial = [line for line in plan.splitlines() if "WindowGroupLimit" in line and "Partial" in line]
    assert partial and {r.v for r in kept.collect()} == set(range(993, 1000))
    assert [(r.k, r.n_rows) for r in dedupe.duplicate_keys(df.limit(8), ["k"]).collect()] == [(0, 2)]


def test_median_of_two_far_clusters_ends_soon(spark):
    values = [x / 1e7 for x in range(1000)] + [1e9 + x / 1000 for x in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    spark.sparkContext.setJobGroup("median", "median")
    assert aggregates.exact_median(df, "v").first()[0] == statistics.median(values)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("median")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 60


@pytest.mark.parametrize("values", [[1e-11] * 1000, [1e18, 1.0, -1e18], [0.1] * 10, [1e300, 1e300]])
def test_sum_keeps_every_digit(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    total = sums.exact_sums(df, [], {"total": F.col("v")}).first()[0]
    assert total == float(sum(map(Fraction, values)))


def test_doubles_are_not_parsed_as_text(spark):
    values = [1.5, -0.0, 0.0, 1e300, -1e-300, 181.0, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    direct = numeric.column_to_number(df, "v")
    assert "string" not in str(direct).lower() and "trim" not in str(direct).lower()
    rows = df.select(direct.alias("got"), numeric.to_number(F.col("v").cast("string")).alias("want")).collect()
    assert [str(r.got) for r in rows] == [str(r.want) for r in rows]
    raw = df.select(
        F.col("id").alias("Site Name"), F.lit("S").alias("State"), F.lit("x").alias("Program"),
        F.col("v").alias("Latitude"), F.lit(2.0).alias("Longitude"), F.col("v").alias("Acreage (acres)"),
    )
    found = sites.brownfield_sites(raw)
    assert "trim(cast(Latitude" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.latitude for r in found.collect()) == [-1e-300, 0.0, 0.0, 1.5]


def test_numbers_in_text_with_blanks_around(spark):
    values = {"1": 1.0, " 2.5\t": 2.5, "3.": 3.0, "1d": None, "1d ": None, "NaN": None, "": None, " ": None, "7 x": None, None: None}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.n for r in df.select("v", numeric.to_number(F.col("v")).alias("n")).collect()}
    assert got == values


def test_last_character_of_a_number(spark):
    values = ["1", "1.", "1\u0663", "1\u00bd", "1/", "1:", "-1", ".", "9", "0x", "1e3", "\u00a05\u2003"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.n for r in df.select("v", numeric.to_number(F.col("v")).alias("n")).collect()}
    assert {k for k, n in got.items() if n is not None} >= {"1", "1.", "-1", "9", "1e3"}
    assert all(got[v] is None for v in ("1\u0663", "1\u00bd", "1/", "1:", ".", "0x"))


def test_places_are_known_and_in_range(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), -181.0, -180.0, -90.5, -90.0, -0.0, 90.0, 90.5, 180.0, 180.5]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "latitude double, longitude double")
    finite = df.where("abs(latitude) < double('inf') AND abs(longitude) < double('inf')")
    want = finite.where(predicates.valid_lat_lon(F.col("latitude"), F.col("longitude"))).collect()
    assert sorted(map(tuple, sites._known_places(df).collect())) == sorted(map(tuple, want)) and len(want) == 3 * 7


def test_cleaning_of_mines_is_compiled(spark, tmp_path):
    """The JVM interprets generated methods of more than 8,000 bytes, which made each row several times as slow."""
    spark.sql("""SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority, 1.5D AS o_totalprice,
        timestamp_ntz '2001-02-03 00:00:00' AS o_orderdate FROM range(9)""").write.parquet(f"{tmp_path}/orders.parquet")
    df = sites.closed_mines(tables.mines_raw(spark, str(tmp_path)))
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    assert {r.mine_id for r in df.collect()} == {1, 2, 4, 5, 7, 8}


def test_shapes_are_digested_before_they_meet_the_sites(spark, tmp_path):
    d = str(tmp_path)
    rows = {
        "region": "0 AS r_regionkey, 'AFRICA' AS r_name", "nation": "0 AS n_nationkey, 'ALGERIA' AS n_name, 0 AS n_regionkey",
        "supplier": "id AS s_suppkey, 0 AS s_nationkey",
        "orders": """id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority, 1.5D AS o_totalprice,
            timestamp_ntz '2001-02-03 00:00:00' AS o_orderdate""",
        "lineitem": """id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 3 AS l_linenumber, 'A' AS l_returnflag, 'F' AS l_linestatus,
            timestamp_ntz '2001-02-03 00:00:00' AS l_shipdate""",
    }
    for name, columns in rows.items():
        spark.sql(f"SELECT {columns} FROM range({1 if name in ('region', 'nation') else 40})").write.parquet(f"{d}/{name}.parquet")
    df = QUERIES["coal_rule_geometry"](spark, d)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("md5")
    found = df.where("geoid IS NOT NULL").collect()
    assert {(r.n_rings, r.n_edges, r.area) for r in found} == {(1, 4, 9.0)}
    assert {r.qualifying_criteria for r in found} == {"coalmine", "coal_plant", "coal_mine_adjacent_tract", "coal_plant_adjacent_tract"}


def test_brownfields_of_a_short_file_are_cleaned_by_all_cores(spark, tmp_path):
    spark.sql("""SELECT id AS c_custkey, 0 AS c_nationkey, 1.5D AS c_acctbal, 'FURNITURE' AS c_mktsegment FROM range(0, 90, 1, 1)""").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    raw = tables.brownfields_raw(spark, str(tmp_path))
    assert raw.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert raw.count() == 90
