"""Exact sums, fingerprints, derived tables, rejects and the run store."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from areaqual import constants as K
from areaqual.functions import geometry as geo
from areaqual.operators import aggregates, fingerprints, quality, rejects, sums
from areaqual.plans import layers
from areaqual.sources import areas, derived, sinks

CASES = {
    "cancel": [1e18, 1e-11, -1e18],
    "tiny": [5e-324] * 7,
    "tiny and large": [1e300, 5e-324, -1e300],
    "halves": [2.0**53, 1.0, 1.0],
    "tie to even": [2.0**53, 1.0],
    "tie broken from below": [2.0**53, 1.0, 1e-300],
    "negative": [-1e16, 1.0, -3.0, -1e-5],
    "zero": [0.0, -0.0, 0.0],
    "sum is zero": [0.1, 0.2, -0.1, -0.2],
    "cents": [0.1] * 1000,
    "over": [1.7e308, 1.7e308, -1.7e308],
    "too large": [1.7e308, 1.7e308],
    "powers": [2.0**k for k in range(-1074, 1024, 7)],
    "alternating": [(-1) ** k * 2.0 ** (k % 900) for k in range(-900, 900, 11)],
}


def exact(values):
    total = sum(map(Fraction, values))
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


@pytest.mark.parametrize("parts,seed", [(1, 0), (5, 1), (16, 2)])
def test_sums_are_those_of_fractions_in_any_order(spark, parts, seed):
    rng = random.Random(seed)
    rows = [(k, v) for k, values in CASES.items() for v in values] + [("cancel", None), ("nothing", None)]
    rows += [(f"random {k}", rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-300, 300)) for k in range(4) for _ in range(40)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    got = {r["k"]: (r["total"], r["n"]) for r in sums.exact_sums(df, ["k"], {"total": F.col("v")}, {"n": F.col("v").isNotNull()}).collect()}
    held = {}
    for k, v in rows:
        held.setdefault(k, []).extend([] if v is None else [v])
    assert got == {k: (exact(v) if v else None, len(v)) for k, v in held.items()}


def test_sums_of_what_is_not_finite(spark):
    inf, nan = math.inf, math.nan
    rows = [("plus", inf), ("plus", -1.0), ("minus", -inf), ("both", inf), ("both", -inf), ("nan", nan), ("nan", 1.0)]
    got = {r["k"]: r["s"] for r in sums.exact_sums(spark.createDataFrame(rows, "k string, v double"), ["k"], {"s": F.col("v")}).collect()}
    assert got["plus"] == inf and got["minus"] == -inf and math.isnan(got["both"]) and math.isnan(got["nan"])


def test_several_sums_and_no_key(spark):
    df = spark.createDataFrame([("a", 1.0, 2.5), ("a", None, 0.5), ("b", 3.0, None)], "k string, x double, y double")
    got = sums.exact_sums(df, ["k"], {"x": F.col("x"), "y": F.col("y")}, {"n": F.lit(True)}).collect()
    assert sorted(map(tuple, got)) == [("a", 1.0, 3.0, 2), ("b", 3.0, None, 1)]
    assert tuple(sums.exact_sums(df, [], {"x": F.col("x")}).first()) == (4.0,)
    empty = df.where("false")
    assert sums.exact_sums(empty, ["k"], {"x": F.col("x")}).collect() == []
    assert tuple(sums.exact_sums(empty, [], {"x": F.col("x")}).first()) == (None,)


def test_acreage_does_not_depend_on_the_order(spark):
    values = [1e17, 0.125, -1e17, 3.375, None, 1e-11]
    got = set()
    for seed in range(3):
        rows = [("c", v) for v in values]
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "county string, acres double").repartition(1 + seed)
        got.add(tuple(aggregates.acreage_three_ways(df, "county", "acres").first()))
    assert got == {("c", 3.5, 4.2, 3.63)}


def area_table(spark, squares):
    rows = [("tract", k, k, None, [[[{"x": a, "y": b} for a, b in ((x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0))]]]) for k, (x, y) in squares.items()]
    df = spark.createDataFrame(rows, f"level string, geoid string, name string, abbr string, raw {geo.GEOMETRY_DDL}")
    return df.select("level", "geoid", "name", "abbr", geo.normalise("raw").alias("geometry"))


def test_a_layer_is_told_apart_from_a_changed_one(spark):
    squares = {f"a{k}": (float(k), 0.0) for k in range(20)}

    def of(named, parts=3):
        layer = layers.layer(area_table(spark, named).repartition(parts), "tract")
        return tuple(fingerprints.layer_fingerprint(layer, "tract_id_fips").first())

    first = of(squares)
    assert first == of(dict(reversed(squares.items())), 7) and first[0] == 20
    others = [squares | {"a3": (3.0, 0.5)}, squares | {"b": (0.0, 0.0)}, {k: v for k, v in squares.items() if k != "a5"},
              squares | {"a1": squares["a2"], "a2": squares["a1"]}, {}]
    prints = [of(o) for o in others[:-1]] + [tuple(fingerprints.layer_fingerprint(layers.layer(area_table(spark, squares).where("false"), "tract"), "tract_id_fips").first())]
    assert len({first, *prints}) == 6 and prints[-1] == (0, "0", 0)


def test_a_derived_table_needs_its_proof(spark, tmp_path):
    path, source = str(tmp_path / "table"), spark.createDataFrame([(1, "5", 7)], "n long, total string, mixed long")
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert derived.read_derived(spark, path, source) is None
    derived.write_derived(df, path, source)
    assert derived.read_derived(spark, path, source).count() == 100
    other = source.withColumn("total", F.lit("6"))
    assert derived.read_derived(spark, path, other) is None
    df.where("id < 99").write.mode("overwrite").parquet(path)  # a part of it
    assert derived.read_derived(spark, path, source) is None
    df.withColumn("x", F.col("x") + 1).write.mode("overwrite").parquet(path)  # an older one
    assert derived.read_derived(spark, path, source) is None


TYPES = {"id": "bigint", "day": "date_us", "n": "int"}


def raw_rows(spark):
    rows = [("1", "01/31/2010", "5"), ("2.0", "1/2/2011", None), ("x", "13/45/2010", "1,234"), ("4", None, "7"), ("5", "soon", "8")]
    return spark.createDataFrame(rows, "id string, day string, n string")


def test_rejects_are_set_aside_with_their_raw_values(spark, tmp_path, caplog):
    policy = rejects.Policy("warn", str(tmp_path / "bad"))
    good = rejects.checked(raw_rows(spark), TYPES, "rows", policy)
    assert sorted(r["id"] for r in good.collect()) == ["1", "2.0", "4"] and good.columns == ["id", "day", "n"]
    bad = spark.read.parquet(str(tmp_path / "bad")).select("source", "column", "raw").collect()
    assert sorted(map(tuple, bad)) == [("rows", "day", "13/45/2010"), ("rows", "day", "soon"), ("rows", "id", "x"), ("rows", "n", "1,234")]
    assert "2 of 5 rows of rows" in caplog.text
    rejects.checked(raw_rows(spark).where("id = 'x'"), TYPES, "others", policy)
    assert spark.read.parquet(str(tmp_path / "bad")).groupBy("source").count().count() == 2


def test_rejects_stop_the_run_or_are_kept(spark, tmp_path):
    with pytest.raises(quality.DataCheckError, match="2 of 5 rows of rows.*soon"):
        rejects.checked(raw_rows(spark), TYPES, "rows", rejects.Policy("fail", str(tmp_path / "bad")))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 4
    assert rejects.checked(raw_rows(spark), TYPES, "rows").count() == 5
    fine = raw_rows(spark).where("id IN ('1', '4')")
    assert rejects.checked(fine, TYPES, "rows", rejects.Policy("fail")).count() == 2
    assert rejects.checked(fine.where("false"), TYPES, "rows", rejects.Policy("fail")).count() == 0
    with pytest.raises(ValueError):
        rejects.Policy("ignore")


def test_a_checked_table_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    raw = raw_rows(spark).mapInArrow(count, "id string, day string, n string")
    good = rejects.checked(raw, TYPES, "rows", rejects.Policy("warn", str(tmp_path / "bad")))
    assert good.count() == 3 and good.count() == 3 and seen.value == 5


def test_layers_in_another_coordinate_system_are_refused(spark, tmp_path):
    table, path = area_table(spark, {"a": (0.0, 0.0)}), str(tmp_path / "areas")
    for other in (table, areas.in_crs(table, "EPSG:3857")):
        with pytest.raises(quality.DataCheckError, match="expected EPSG:4269"):
            areas.write_areas(other, path)
    areas.write_areas(areas.in_crs(table, K.GEOGRAPHIC_CRS), path)
    assert areas.crs_of(areas.read_areas(spark, path)) == K.GEOGRAPHIC_CRS
    with pytest.raises(quality.DataCheckError, match="expected EPSG:4326"):
        areas.read_areas(spark, path, "EPSG:4326")
    for k, other in enumerate((table, areas.in_crs(table, "EPSG:3857"))):
        other.write.partitionBy("level").parquet(f"{path}-{k}")
        with pytest.raises(quality.DataCheckError, match="not named|EPSG:3857"):
            areas.read_areas(spark, f"{path}-{k}")


def test_a_run_store_removes_its_tables(spark):
    with sinks.RunStore(spark) as store:
        folder = store.folder
        df = store(spark.range(5), "five")
        assert df.count() == 5 and spark.read.parquet(f"{folder}/001-five").count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/001-five")
    with pytest.raises(KeyError), sinks.RunStore(spark) as store:
        folder = store.folder
        store(spark.range(5), "five")
        raise KeyError
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/001-five")


def test_geometry_attached_by_id_with_its_name_and_digest(spark):
    layer = layers.layer(area_table(spark, {"a": (0.0, 0.0), "b": (5.0, 1.0)}), "tract")
    df = spark.createDataFrame([("a", 1), ("zz", 2), (None, 3)], "tract_id_fips string, k int")
    got = layers.add_geometry(df, layer, "tract_id_fips", add_name=True).select("k", "tract_name", geo.digest("area_geometry").alias("d"))
    rows = {r["k"]: r for r in got.collect()}
    assert rows[1]["tract_name"] == "a" and rows[2]["tract_name"] is None and rows[2]["d"] is None and rows[3]["d"] is None
    d = rows[1]["d"]
    assert (d["n_rings"], d["n_edges"], d["area"], d["min_x"], d["max_y"]) == (1, 4, 1.0, 0.0, 1.0)
    turned = spark.createDataFrame([([[[{"x": x, "y": y} for x, y in ((1.0, 1.0), (0.0, 1.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0))]]],)], f"g {geo.GEOMETRY_DDL}")
    assert turned.select(geo.digest("g").alias("d")).first()["d"]["vertices"] == d["vertices"]


def test_rows_are_summed_without_lists_or_decimals(spark):
    """Only the few partial sums are made into lists; before, each row was."""
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    made = sums.exact_sums(df, ["k"], {"s": F.col("v")}, {"n": F.lit(True)})
    optimized = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = max(i for i, line in enumerate(optimized) if "Aggregate" in line)  # the one next to the rows
    assert "sum(shiftright(" in optimized[first]
    assert not any("Generate" in line or "lambda" in line for line in optimized[first:])


def test_sums_at_the_border_of_small_and_large_values(spark):
    """Decimals are held in two ways, below and from 100,000; both may meet in a key, and their sum may not be held at all."""
    values = {
        "both": [99999.9999999999, 100000.1, -99999.9, 0.3, 1e20, None, -0.0],
        "negative": [-0.1] * 30 + [-100000.7, 0.0000000001, -0.0000000003],
        "many": [99999.9999999999] * 2000,
        "eleven decimals": [0.1, 0.2, 0.00000000001],
        "large and eleven decimals": [123456.7, 1e-11],
        "overflow": [9e25] * 120,
    }
    rows = [(k, v) for k, vs in values.items() for v in vs]
    got = {r["k"]: (r["s"], r["n"]) for r in sums.exact_sums(
        spark.createDataFrame(rows, "k string, v double"), ["k"], {"s": F.col("v")}, {"n": F.lit(True)}).collect()}
    as_written = ("both", "negative", "many")
    want = {k: float(sum(Fraction(repr(v)) if k in as_written else Fraction(v) for v in vs if v is not None)) for k, vs in values.items()}
    assert got == {k: (want[k], len(values[k])) for k in values}


def test_a_key_and_a_count_may_be_named_like_the_value(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.5,)], "v double")
    got = sums.exact_sums(df, ["v"], {"s": F.col("v"), "t": F.col("v") * 2}, {"n": F.col("v") > 1}).collect()
    assert sorted(map(tuple, got)) == [(1.0, 2.0, 4.0, 0), (2.5, 2.5, 5.0, 1)]
