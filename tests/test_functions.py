import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from areaqual.functions import geometry as geo
from areaqual.functions import numeric, predicates, text


def column(spark, values, expression, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.r for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_strip_removes_tabs_and_no_break_spaces(spark):
    assert column(spark, ["\t a b  ", "x", None], text.strip) == ["a b", "x", None]


def test_title_case_after_every_non_letter(spark):
    got = column(spark, [" o'brien-smith 3rd", "ÑANDÚ lake", "", None], text.strip_title)
    assert got == ["O'Brien-Smith 3Rd", "Ñandú Lake", "", None]


def test_padding_never_shortens(spark):
    assert column(spark, ["7", "12345", "123456", None], lambda c: text.zero_fill(c, 5)) == [
        "00007", "12345", "123456", None,
    ]
    assert column(spark, ["LAU1", "LAU1234567"], lambda c: text.zero_fill_right(c, 6)) == ["LAU100", "LAU1234567"]


def test_to_number_coerces(spark):
    values = ["1.5", "  2 ", "-", "", "1d", "2.5F", "NaN", "1e3", None]
    assert column(spark, values, numeric.to_number) == [1.5, 2.0, None, None, None, None, None, 1000.0, None]


def test_round_half_even(spark):
    values = [0.25, 0.35, 2.5, -0.25, None]
    assert column(spark, values, lambda c: numeric.round_half_even(c, 1), "double") == [0.2, 0.4, 2.5, -0.2, None]


def test_floor_percent_keeps_double_arithmetic(spark):
    assert column(spark, [0.29, 0.035, 0.2109], numeric.floor_percent, "double") == [
        28.999999999999996, 3.5000000000000004, 21.0,
    ]


def test_flag_of_unknown_is_zero(spark):
    nan = float("nan")
    got = column(spark, [1.0, -1.0, None, nan], lambda c: numeric.flag(numeric.nan_to_null(c) > 0), "double")
    assert got == [1, 0, 0, 0]


def test_lat_lon_range_keeps_unknown(spark):
    rows = [(1.1, 2.9), (2.3, 181.1), (-90.5, -180.1), (None, 3.5), (90.0, -180.0), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "latitude double, longitude double")
    kept = df.where(predicates.valid_lat_lon(F.col("latitude"), F.col("longitude"))).collect()
    assert [r.longitude for r in kept] == [2.9, 3.5, -180.0, 0.0]


def test_exclusion_keeps_null(spark):
    got = column(spark, ["superfund", "other", None], lambda c: predicates.differs_or_unknown(c, "superfund"))
    assert got == [False, True, True]


def test_fact_filter_keeps_unknown_employment(spark):
    df = spark.createDataFrame([("10", None), ("10", 0), ("211", 5), ("999", 5)], "code string, n bigint")
    kept = df.where(predicates.fact_of_interest(F.col("code"), F.col("n"), ["211"])).collect()
    assert [(r.code, r.n) for r in kept] == [("10", None), ("211", 5)]


def test_generator_regimes(spark):
    rows = [
        ("2009-12-31", "BIT", "Conventional Steam Coal", False),
        ("2010-01-01", "BIT", None, True),
        ("2013-12-31", "NG", "Conventional Steam Coal", False),
        ("2014-01-01", "BIT", "Natural Gas", False),
        ("2014-01-01", "NG", "Conventional Steam Coal", True),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "d string, fuel string, tech string")
    rule = predicates.coal_generator(F.col("d").cast("timestamp"), F.col("fuel"), F.col("tech"))
    got = [bool(r.ok) for r in df.select(rule.alias("ok")).collect()]
    assert got == [r[3] for r in rows]


def test_orientation_is_exact_near_the_line(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        ax, ay, bx, by = (rng.uniform(-120, 60) for _ in range(4))
        t = rng.random()
        cx, cy = (bx, by) if i % 5 == 0 else (ax + t * (bx - ax), ay + t * (by - ay))
        rows.append((ax, ay, bx, by, cx, cy))
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, cx double, cy double")
    sign = F.expr(geo.orientation("ax", "ay", "bx", "by", "cx", "cy")).alias("s")
    for r in df.select("*", sign).collect():
        a = [Fraction(v) for v in r[:6]]
        exact = (a[0] - a[4]) * (a[3] - a[5]) - (a[1] - a[5]) * (a[2] - a[4])
        assert r.s == (exact > 0) - (exact < 0)


def test_normalise_closes_and_turns_rings(spark):
    ring = [(0, 0), (0, 2), (2, 2), (2, 2), (2, 0)]
    hole = [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 0.5)]
    raw = [[[{"x": float(x), "y": float(y)} for x, y in r] for r in (ring, hole)], [[{"x": 9.0, "y": 9.0}]]]
    df = spark.createDataFrame([(raw,)], f"g {geo.GEOMETRY_DDL}")
    row = df.select(geo.normalise("g").alias("g")).select("g", geo.planar_area("g").alias("a")).first()
    assert len(row.g) == 1 and len(row.g[0][0]) == 5 and row.a == pytest.approx(4 - 0.125)
    assert [(p.x, p.y) for p in row.g[0][0]][:2] == [(0.0, 0.0), (2.0, 0.0)]
    assert [(p.x, p.y) for p in row.g[0][1]][1] == (1.0, 1.0)


def test_transverse_mercator_known_points(spark):
    # Published values: the 45 degree meridian arc of GRS80, and a tower in Toronto (zone 17).
    df = spark.sql("SELECT array(named_struct('x', -99D, 'y', 45D)) AS a, array(named_struct('x', -79.387139D, 'y', 43.642567D)) AS b")
    row = df.select(F.expr(geo.project_points("a")).alias("a"), F.expr(geo.project_points("b", -81.0)).alias("b")).first()
    assert row.a[0].x == pytest.approx(500000.0, abs=1e-6)
    assert row.a[0].y == pytest.approx(0.9996 * 4984944.378, abs=0.01)
    assert row.b[0].x == pytest.approx(630084, abs=1) and row.b[0].y == pytest.approx(4833439, abs=1)


def test_utm_area_of_a_small_square(spark):
    corners = [(-99.0, 40.0), (-98.99, 40.0), (-98.99, 40.01), (-99.0, 40.01)]
    raw = [[[{"x": x, "y": y} for x, y in corners]]]
    df = spark.createDataFrame([(raw,)], f"g {geo.GEOMETRY_DDL}").select(geo.normalise("g").alias("g"))
    # 1 degree of latitude is 111.035 km and of longitude 85.394 km there.
    assert df.select(geo.utm_area("g")).first()[0] == pytest.approx(1110.35 * 853.87 * 0.9996**2, rel=2e-4)
