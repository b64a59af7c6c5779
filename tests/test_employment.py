"""Golden cases of the employment rule on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from areaqual import constants as K
from areaqual.operators import quality
from areaqual.plans import crosswalks, employment

METRO = [("48059", "C1018", "Abilene, TX"), ("48253", "C1018", "Abilene, TX"), ("48441", "C1018", "Abilene, TX"),
         ("04027", "C4974", "Yuma, AZ")]
NON_METRO = [("01005", "100004", "Southeast Alabama nonmetropolitan area"),
             ("01109", "100004", "Southeast Alabama nonmetropolitan area")]
XW = "county_id_fips string, msa_code string, msa_name string"

FACTS = [
    # 2012: 110 of 66000, just under the threshold
    ("48059", "Callahan County", 2012, "10", 0, 40000), ("48253", "Jones County", 2012, "10", 0, 6000),
    ("48441", "Taylor County", 2012, "10", 0, 20000), ("48059", "Callahan County", 2012, "211", 5, 60),
    ("48441", "Taylor County", 2012, "213111", 5, 50), ("48441", "Taylor County", 2012, "4861", 5, 0),
    # 2020: 1220 of 67929
    ("48059", "Callahan County", 2020, "10", 0, 50000), ("48253", "Jones County", 2020, "10", 0, 10000),
    ("48441", "Taylor County", 2020, "10", 0, 7929), ("48441", "Taylor County", 2020, "211", 5, 700),
    ("48059", "Callahan County", 2020, "213112", 3, 500), ("48253", "Jones County", 2020, "32411", 5, 20),
    # other ownership of the total, statistical areas and unlisted industries do not count
    ("48059", "Callahan County", 2020, "10", 5, 999999), ("C1018", "Abilene, TX MSA", 2020, "10", 0, 67929),
    ("48059", "Callahan County", 2020, "5415", 5, 4000), ("48059", None, 2020, "211", 5, 4000),
    # four digits, 62 of 65963
    ("4027", "Yuma County", 2020, "10", 0, 65963), ("4027", "Yuma County", 2020, "4862", 5, 62),
    # 1700 of 22269
    ("01005", "Barbour County", 2020, "10", 0, 8000), ("01005", "Barbour County", 2020, "2121", 5, 1000),
    ("01109", "Pike County", 2020, "10", 0, 14269), ("01109", "Pike County", 2020, "211", 5, 700),
    # in no crosswalk
    ("09005", "Litchfield County", 2020, "10", 0, 56898), ("09015", "Windham County", 2020, "211", 0, 100),
]

# (county, year, unemployed months, labour force months)
SERIES = [
    ("48059", 2019, [100.0, 150.0], [3500.0, 3600.0]), ("48059", 2020, [500.0, 448.0], [2000.0, 2500.0]),
    ("01005", 2020, [344.0, 675.0], [8680.0, 8636.0]), ("01109", 2020, [500.0, 864.0], [15570.0, 15800.0]),
]


@pytest.fixture(scope="module")
def metro(spark):
    return spark.createDataFrame(METRO, XW)


@pytest.fixture(scope="module")
def non_metro(spark):
    return spark.createDataFrame(NON_METRO, XW)


@pytest.fixture(scope="module")
def raw_facts(spark):
    return spark.createDataFrame(
        FACTS, "`Area FIPS` string, `area title` string, year int, `industry_code ` string, own_code int, annual_avg_emplvl int"
    )


@pytest.fixture(scope="module")
def raw_series(spark):
    rows = []
    for county, year, unemployed, force in SERIES:
        for measure, values in (("04", unemployed), ("06", force)):
            rows += [(f"LAUCN{county}00000000{measure}", year, f"M{m:02d}", f" {v}") for m, v in enumerate(values, 1)]
            rows.append((f"LAUCN{county}00000000{measure}", year, "M13", "99999"))
            rows.append((f"LAUCN{county}00000000{measure}", year, "M05", "-"))
        rows.append((f"LAUCN{county}0000000003", year, "M01", "5"))
        rows.append((f"LAUMT{county}0000000004", year, "M01", "5"))
    return spark.createDataFrame(rows, "`series_id  ` string, year int, period string, `  value` string")


@pytest.fixture(scope="module")
def national(spark):
    return spark.createDataFrame([(2018, 3.9, 2019), (2019, 3.7, 2020)],
                                 "real_year int, national_unemployment_rate double, applies_to_criteria_year int")


@pytest.fixture(scope="module")
def shares(raw_facts, metro, non_metro):
    return employment.fossil_share_by_county(employment.employment_facts(raw_facts, metro, non_metro))


@pytest.fixture(scope="module")
def unemployment(raw_series, metro, non_metro, national):
    return employment.unemployment_flags(national, employment.local_rates(raw_series, metro, non_metro))


def test_fossil_shares(shares):
    got = {(r.msa_code, r.county_id_fips, r.year): r for r in shares.collect()}
    assert set(got) == {("C1018", c, y) for c in ("48059", "48253", "48441") for y in (2012, 2020)} | {
        ("C4974", "04027", 2020), ("100004", "01005", 2020), ("100004", "01109", 2020)}
    expected = {("C1018", 2012): (66000, 110, 0.0017, 0), ("C1018", 2020): (67929, 1220, 0.018, 1),
                ("C4974", 2020): (65963, 62, 0.0009, 0), ("100004", 2020): (22269, 1700, 0.0763, 1)}
    for (msa, county, year), r in got.items():
        total, fossil, share, flag = expected[msa, year]
        assert (r.total_employees, r.fossil_employees, r.meets_fossil_employment_threshold) == (total, fossil, flag)
        assert round(r.percent_fossil_employment, 4) == share and r.geoid == county
    assert got["C1018", "48059", 2020].naics_code == ["211", "213112", "32411"]
    assert got["C1018", "48059", 2020].area_title == "Abilene, TX"


def test_local_rates_and_flags(unemployment):
    got = {(r.county_id_fips, r.year): r for r in unemployment.collect()}
    assert set(got) == {("48059", 2019), ("48059", 2020), ("01005", 2020), ("01109", 2020)}
    rates = {k: (pytest.approx(r.local_area_unemployment_rate), r.meets_unemployment_threshold) for k, r in got.items()}
    assert rates == {("48059", 2019): (3.5, 0), ("48059", 2020): (21.0, 1), ("01005", 2020): (4.8, 1),
                     ("01109", 2020): (4.8, 1)}
    assert got["01005", 2020].series_id == "LAUCN010050000000004"


def test_employment_rule(spark, shares, unemployment):
    states = spark.createDataFrame([("48", "TX", "Texas"), ("01", "AL", "Alabama")],
                                   "state_id_fips string, state_abbr string, state_name string")
    counties = spark.createDataFrame([("48059", "Callahan County"), ("01005", "Barbour County"), ("01109", "Pike County")],
                                     "county_id_fips string, county_name string")
    rows = employment.employment_rule(shares, unemployment, states, counties).orderBy("geoid").collect()
    assert [tuple(r) for r in rows] == [
        (name, fips, fips[:2], abbr, state, fips, site, "fossil_fuel_employment", "MSA or non-MSA")
        for name, fips, abbr, state, site in (
            ("Barbour County", "01005", "AL", "Alabama", "Southeast Alabama nonmetropolitan area"),
            ("Pike County", "01109", "AL", "Alabama", "Southeast Alabama nonmetropolitan area"),
            ("Callahan County", "48059", "TX", "Texas", "Abilene, TX"),
        )
    ]


def test_both_conditions_must_hold_in_one_year(spark):
    shares = spark.createDataFrame([("a", "a", 2010, "m", "t", 1), ("a", "a", 2011, "m", "t", 0), ("b", "b", 2012, "m", "u", 1),
                                    ("b", "b", 2010, "m", "t", 1)],
                                   "geoid string, county_id_fips string, year int, msa_code string, area_title string, "
                                   "meets_fossil_employment_threshold int")
    rates = spark.createDataFrame([("a", 2011, 1), ("b", 2010, 1), ("b", 2012, 1)],
                                  "geoid string, year int, meets_unemployment_threshold int")
    states = spark.createDataFrame([], "state_id_fips string, state_abbr string, state_name string")
    counties = spark.createDataFrame([], "county_id_fips string, county_name string")
    rows = employment.employment_rule(shares, rates, states, counties).collect()
    assert [(r.geoid, r.site_name) for r in rows] == [("b", "t")]


def test_share_edge_cases(spark):
    rows = [
        ("only_total", 2020, "10", 0, 50), ("only_part", 2020, "211", 5, 9), ("zero_total", 2020, "10", 0, None),
        ("zero_total", 2020, "211", 5, 1), ("private_total", 2020, "10", 5, 70), (None, 2020, "10", 0, 5),
    ]
    df = spark.createDataFrame([(a, f"c{a}", "t", y, c, o, n) for a, y, c, o, n in rows],
                               "msa_code string, county_id_fips string, area_title string, year int, industry_code string, "
                               "own_code int, annual_avg_emplvl bigint")
    got = {r.msa_code: r for r in employment.fossil_share_by_county(df).collect()}
    flags = {k: r.meets_fossil_employment_threshold for k, r in got.items()}
    assert flags == {"only_total": 0, "only_part": 0, "zero_total": 1, "private_total": None, None: None}
    assert got["only_part"].total_employees is None and got["only_total"].fossil_employees == 0
    assert [tuple(r) for r in employment.areas_without_total(employment.fossil_share_by_county(df)).collect()] == [
        ("only_part", 2020)]
    assert got["only_total"].naics_code is None and got["only_part"].naics_code == ["211"]


def test_share_does_not_depend_on_partitioning(raw_facts, metro, non_metro, shares):
    again = employment.fossil_share_by_county(
        employment.employment_facts(raw_facts.repartition(7), metro, non_metro)
    )
    assert again.exceptAll(shares).count() == 0


def test_scenarios(raw_facts, metro, non_metro):
    lists = {"current": K.FOSSIL_CODES, "oil_only": ["211"]}
    facts = employment.employment_facts(raw_facts, metro, non_metro)
    got = {(r.scenario, r.msa_code, r.year): r.fossil_employees
           for r in employment.fossil_share_by_scenario(facts, lists).collect()}
    assert got["current", "C1018", 2020] == 1220 and got["oil_only", "C1018", 2020] == 700
    assert got["oil_only", "C4974", 2020] == 0 and len(got) == 8


def test_zero_labour_force_gives_no_rate(spark, metro, non_metro):
    rows = [("LAUCN040270000000004", 2020, "M01", "3"), ("LAUCN040270000000006", 2020, "M01", "0"),
            ("LAUCN480590000000006", 2020, "M01", "100"), ("LAUCN010050000000004", 2020, "M01", "7")]
    raw = spark.createDataFrame(rows, "series_id string, year int, period string, value string")
    got = {r.county_id_fips: (r.total_labor_force, r.local_area_unemployment_rate)
           for r in employment.local_rates(raw, metro, non_metro).collect()}
    # A labour force without unemployment drops out, unemployment without labour force has no rate.
    assert got == {"04027": (0.0, None), "01005": (None, None)}


def test_monthly_means_round_half_even(spark):
    rows = [("LAUCN010050000000004", 2020, f"M0{m}", v) for m, v in ((1, "0.1"), (2, "0.4"), (3, None))]
    raw = spark.createDataFrame(rows, "series_id string, year int, period string, value string")
    assert employment.county_unemployment(raw).first().total_unemployment == 0.2


def test_county_in_two_areas_stops_the_run(spark, raw_series, metro, non_metro):
    twice = non_metro.union(spark.createDataFrame([("48059", "x", "x")], XW))
    with pytest.raises(Exception, match="more than one statistical area"):
        employment.local_rates(raw_series, metro, twice).collect()


def test_two_series_of_a_county_stop_the_run(spark, metro, non_metro):
    rows = [("LAUCN010050000000004", 2020, "M01", "1"), ("LAUCN010050000000104", 2020, "M01", "1")]
    raw = spark.createDataFrame(rows, "series_id string, year int, period string, value string")
    with pytest.raises(Exception, match="two unemployment series"):
        employment.local_rates(raw, metro, non_metro).collect()


def test_national_rate(spark):
    rows = [("2019", f"M{m:02d}", "x", v, " LNS ") for m, v in ((1, "4.0"), (2, "3.8"), (3, "3.8"), (13, "9.9"))]
    rows.append((None, "M01", "x", "9.0", "LNS"))
    raw = spark.createDataFrame(rows, "year string, period string, periodName string, value string, `Series_ID ` string")
    assert [tuple(r) for r in employment.national_rate(raw).collect()] == [(2019, 3.9, 2020)]


def test_area_table(spark):
    rows = [("A", "ST0100000000000", "Alabama"), ("B", "MT0113820000000", "Birmingham"), ("F", "CN0100100000000", "Autauga")]
    raw = spark.createDataFrame(rows, " ` area_type_code` string, `AREA_CODE` string, area_text string")
    got = [(r.state_id_fips, r.series_id, r.msa_code, r.county_id_fips)
           for r in employment.local_area_table(raw).orderBy("area_text").collect()]
    assert got == [("01", "LAUCN0100100000000", None, "01001"), ("01", "LAUMT0113820000000", "C1382", None)]


def test_crosswalks(spark):
    metro = crosswalks.metro_crosswalk(spark.createDataFrame(
        [("1001", "C1", "One", "Autauga", "Metro"), ("1003", "C2", "Two", "Baldwin", "Micro")],
        "` County Code` string, `MSA Code` string, `MSA Title` string, `County Title` string, `MSA Type` string"))
    assert [(r.county_id_fips, r.msa_code) for r in metro.collect()] == [("01001", "C1")]
    definitions = spark.createDataFrame(
        [("1", "1", "0", "South nonmetropolitan area", "100", "Autauga"),  # already metropolitan
         ("1", "3", "0", "West nonmetropolitan area", "300", "Baldwin"),
         ("1", "3", "7", "South nonmetropolitan area", "100", "Baldwin"),  # split county
         ("1", "5", "0", "Some city", "555", "Barbour"),
         (None, "9", "0", "South nonmetropolitan area", "100", "nowhere")],
        "`FIPS code` string, `County code` string, `Township code` string, `May 2023 MSA name` string, "
        "`May 2023 MSA code ` string, `County name (or Township name)` string")
    got = crosswalks.non_metro_crosswalk(definitions, metro).collect()
    assert {(r.county_id_fips, r.msa_code, r.state_id_fips, r.township_id_fips) for r in got} == {
        ("01003", "100", "01", "007"), (None, "100", None, "000")}
    with pytest.raises(ValueError, match="msa_name"):
        crosswalks.non_metro_crosswalk(definitions.drop("May 2023 MSA name"), metro)


def test_warnings(raw_facts, raw_series, metro, non_metro):
    unmatched = employment.unmatched_counties(raw_facts, metro, non_metro)
    assert {r[0] for r in unmatched.collect()} == {"09005", "09015"}
    missing = employment.counties_without_rates(raw_series, metro, non_metro)
    assert {r[0] for r in missing.collect()} == {"48253", "48441", "04027"}


def test_observed_counts(spark):
    df, seen = quality.observe_counts(spark.range(10), "checks", {"odd": F.col("id") % 2 == 1, "unknown": F.lit(None).cast("boolean")})
    df.count()
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"odd": 5, "unknown": 0}


def test_summing_before_the_crosswalk_gives_the_same_shares(raw_facts, metro, non_metro, shares):
    totals = employment.county_totals(raw_facts, metro, non_metro)
    again = employment.shares_of_totals(totals).select(*shares.columns)
    assert again.exceptAll(shares).count() == 0 and shares.exceptAll(again).count() == 0
    plan = totals._jdf.queryExecution().executedPlan().toString()
    # The aggregate lies below the join, so the fact rows are never shuffled one by one.
    assert plan.index("Join") < plan.index("partial_sum")
