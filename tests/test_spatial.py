import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from areaqual.functions import geometry as geo
from areaqual.operators import adjacency as adj
from areaqual.operators import joins, quadtree, quality, spatial
from areaqual.sources import sinks
from tests import shapes


def layer(spark, named):
    rows = [(k, shapes.geometry(polygons)) for k, (polygons, _) in named.items()]
    return spark.createDataFrame(rows, shapes.SCHEMA).select("geoid", geo.normalise("raw").alias("geometry"))


@pytest.mark.parametrize("seed", [1, 2])
def test_points_in_random_shapes(spark, seed):
    named = shapes.random_shapes(60, 25, seed)
    points = [(i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-2, 62) for y in range(-2, 62, 3))]
    points += [(100_000, None, 1.0), (100_001, 3.0, None)]
    df = spark.createDataFrame(points, "id int, longitude double, latitude double")
    got = {(r.id, r.geoid) for r in spatial.intersect_join(df, layer(spark, named), "geoid").collect()}
    want = set()
    for i, x, y in points:
        hits = [] if x is None or y is None else [k for k, (_, c) in named.items() if shapes.contains(c, x, y)]
        want |= {(i, k) for k in hits} or {(i, None)}
    assert got == want


def test_points_on_mixed_scales(spark):
    """Large and tiny areas share one join through several levels of the index."""
    def square(x, y, s):
        return [([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], [])]

    squares = {f"tiny{i}": (i * 0.25, 0.0, 0.25) for i in range(40)} | {
        "mid": (0.0, 0.0, 8.0), "huge": (-500.0, -500.0, 1000.0)
    }
    rows = [(k, shapes.geometry(square(*v))) for k, v in squares.items()]
    areas = spark.createDataFrame(rows, shapes.SCHEMA).select("geoid", geo.normalise("raw").alias("geometry"))
    index = quadtree.build_index(areas, "geoid")
    assert len(index.levels) > 1
    points = [(i, i * 0.125, (i % 5) * 0.125) for i in range(100)]
    df = spark.createDataFrame(points, "id int, longitude double, latitude double")
    got = {(r.id, r.geoid) for r in spatial.intersect_join(df, areas, "geoid", index=index).collect()}
    want = {
        (i, k) for i, x, y in points for k, (ax, ay, s) in squares.items() if ax <= x <= ax + s and ay <= y <= ay + s
    }
    assert got == want


def test_slanted_borders(spark):
    """Points stored on a slanted edge are on the border; exact rational arithmetic decides."""
    rng = random.Random(5)
    triangle = [(-111.3, 39.1), (-110.2, 39.7), (-111.0, 40.3)]
    rows = [("t", [[[{"x": x, "y": y} for x, y in triangle]]])]
    areas = spark.createDataFrame(rows, shapes.SCHEMA).select("geoid", geo.normalise("raw").alias("geometry"))
    points = []
    for i in range(600):
        (ax, ay), (bx, by) = triangle[i % 3], triangle[(i + 1) % 3]
        t = rng.random()
        points.append((i, ax + t * (bx - ax), ay + t * (by - ay)))
    points += [(1000 + k, *p) for k, p in enumerate(triangle)]

    def inside(x, y):
        signs = []
        for (ax, ay), (bx, by) in zip(triangle, triangle[1:] + triangle[:1]):
            a = [Fraction(v) for v in (ax, ay, bx, by, x, y)]
            signs.append((a[2] - a[0]) * (a[5] - a[1]) - (a[3] - a[1]) * (a[4] - a[0]) >= 0)
        return all(signs)

    df = spark.createDataFrame(points, "id int, longitude double, latitude double")
    got = {r.id for r in spatial.intersect_join(df, areas, "geoid").where("geoid IS NOT NULL").collect()}
    assert got == {i for i, x, y in points if inside(x, y)}


@pytest.mark.parametrize("seed,n,extent", [(1, 40, 14), (2, 60, 22), (3, 30, 8)])
def test_adjacency_of_random_shapes(spark, seed, n, extent):
    """Overlaps, copies, holes, fillings, islands and corner contact, against cell counting."""
    named = shapes.random_shapes(n, extent, seed)
    got = {(r.geoid, r.adjacent_geoid) for r in adj.adjacency(layer(spark, named), "geoid").collect()}
    want = {(a, b) for a in named for b in named if a != b and shapes.touch(named[a][1], named[b][1])}
    assert got == want


def test_adjacency_special_cases(spark):
    ring, unit, square = shapes._RING, shapes._UNIT, shapes._SQUARE
    named = {
        "ring": shapes.placed(ring, 0, 0),
        "filler": shapes.placed(unit, 1, 1),
        "copy_of_filler": shapes.placed(unit, 1, 1),
        "inside_square": shapes.placed(unit, 21, 1),
        "square": shapes.placed(square, 20, 0),
        "corner": shapes.placed(square, 23, 3),
        "alone": shapes.placed(square, 90, 90),
    }
    got = {(r.geoid, r.adjacent_geoid) for r in adj.adjacency(layer(spark, named), "geoid").collect()}
    pairs = {("ring", "filler"), ("ring", "copy_of_filler"), ("square", "corner")}
    assert got == pairs | {(b, a) for a, b in pairs}


def test_part_without_contact_decides(spark):
    """A multipolygon whose second part lies inside the other area does not touch it."""
    a = [([(0, 0), (4, 0), (4, 4), (0, 4)], [])]
    b = [([(4, 0), (6, 0), (6, 2), (4, 2)], []), ([(1, 1), (2, 1), (2, 2), (1, 2)], [])]
    named = {"a": (a, None), "b": (b, None)}
    assert adj.adjacency(layer(spark, named), "geoid").count() == 0


def test_adjacency_of_a_jittered_mesh(spark):
    """Slanted shared borders with decimal coordinates, and a T-junction on every tenth one."""
    rng = random.Random(11)
    n = 12
    vertex = {
        (i, j): (-110 + i * 0.07 + rng.uniform(-0.02, 0.02), 39 + j * 0.07 + rng.uniform(-0.02, 0.02))
        for i in range(n + 1) for j in range(n + 1)
    }
    rows, want = [], set()
    for i in range(n):
        for j in range(n):
            corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            rows.append((f"{i}-{j}", [[[{"x": vertex[c][0], "y": vertex[c][1]} for c in corners]]]))
            want |= {
                (f"{i}-{j}", f"{u}-{v}") for u in range(i - 1, i + 2) for v in range(j - 1, j + 2)
                if (u, v) != (i, j) and 0 <= u < n and 0 <= v < n
            }
    areas = spark.createDataFrame(rows, shapes.SCHEMA).select("geoid", geo.normalise("raw").alias("geometry"))
    got = {(r.geoid, r.adjacent_geoid) for r in adj.adjacency(areas, "geoid").collect()}
    assert got == want


def wavy_ring(n, radius, phase=0.0, x=0.0, y=0.0):
    """A ring of n vertices around a point, with many bays and capes."""
    out = []
    for k in range(n):
        angle = 2 * math.pi * k / n + phase
        r = radius * (1 + 0.3 * math.sin(17 * angle) + 0.1 * math.sin(233 * angle))
        out.append((x + r * math.cos(angle), y + r * math.sin(angle)))
    return out


def exact_place(rings, x, y):
    """0, 1 or 2 over all edges, by rational arithmetic for those above the point or at its height."""
    odd, fx, fy = 0, Fraction(x), Fraction(y)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if not min(ax, bx) <= x <= max(ax, bx) or y > max(ay, by):
                continue
            ax, ay, bx, by = map(Fraction, (ax, ay, bx, by))
            turn = (ax - fx) * (by - fy) - (ay - fy) * (bx - fx)
            if turn == 0 and min(ax, bx) <= fx <= max(ax, bx) and min(ay, by) <= fy <= max(ay, by):
                return 2
            if (ax > fx) != (bx > fx) and turn * (1 if bx > ax else -1) < 0:
                odd ^= 1
    return odd


@pytest.mark.parametrize("bound", [6, 48])
def test_cells_of_many_vertices_are_bounded_and_exact(spark, bound):
    """Random points, vertices, middles of edges and corners of cells against an exact count over all edges."""
    rng = random.Random(bound)
    areas = {
        "coast": [wavy_ring(1500, 10.0), wavy_ring(200, 2.0, 0.1)],
        "comb": [[(x, y) for k in range(60) for x, y in ((k, 8), (k + 0.5, -8))] + [(60, 8), (60, -9), (0, -9)]],
        "far": [wavy_ring(500, 1e-3, 0.3, -111.25, 39.5)],
        "square": [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]],
    }
    rows = [(k, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]]) for k, rings in areas.items()]
    df = spark.createDataFrame(rows, shapes.SCHEMA).select("geoid", F.col("raw").alias("open"))
    closed = df.select("geoid", F.expr("transform(open, p -> transform(p, r -> concat(r, array(r[0]))))").alias("geometry"))
    index = quadtree.build_index(closed, "geoid", bound=bound)
    cells = index.cells.select("geoid", "level", "cx", "cy", F.size("edges").alias("n")).collect()
    assert max(c["n"] for c in cells) <= bound and any(c["n"] == 0 for c in cells)
    points = set()
    for rings in areas.values():
        for ring in rings:
            for _ in range(40):
                (ax, ay), (bx, by) = ring[k := rng.randrange(len(ring))], ring[(k + 1) % len(ring)]
                points |= {(float(ax), float(ay)), ((ax + bx) / 2, (ay + by) / 2), (ax + rng.gauss(0, 0.1), ay + rng.gauss(0, 0.1))}
    for c in rng.sample(cells, min(len(cells), 200)):
        size = 2.0 ** c["level"]
        points.add(((c["cx"] + rng.randrange(2)) * size, (c["cy"] + rng.randrange(2)) * size))
    probes = spark.createDataFrame(sorted(points), "x double, y double")
    got = {(r["x"], r["y"], r["geoid"]): r["place"] for r in quadtree.locate(probes, index, "x", "y").collect()}
    want = {(x, y, k): v for x, y in points for k, rings in areas.items() if (v := exact_place(rings, x, y))}
    assert got == want


def test_an_area_with_thousands_of_neighbours(spark):
    """A long ribbon between two rows of unit squares; no row of the pair tests holds a whole border."""
    n = 1000
    ribbon = [(x, 0) for x in range(n + 1)] + [(x, 1) for x in range(n, -1, -1)]
    named = {"ribbon": ([(ribbon, [])], None)}
    for i in range(n):
        named[f"a{i:04d}"] = ([([(i, 1), (i + 1, 1), (i + 1, 2), (i, 2)], [])], None)
        named[f"b{i:04d}"] = ([([(i, -1), (i + 1, -1), (i + 1, 0), (i, 0)], [])], None)
    stored = []
    got = adj.adjacency(layer(spark, named), "geoid", store=lambda df, name: stored.append((name, sinks.write_and_reuse(df, name))) or stored[-1][1])
    pairs = got.collect()
    assert sum(r["geoid"] == "ribbon" for r in pairs) == 2 * n
    assert len(pairs) == 2 * (2 * n + 2 * (n - 1))
    sizes = {name: df.select(F.max(F.size("edges"))).first()[0] for name, df in stored if "edges" in df.columns and name != "sized-areas"}
    assert sizes["area-cells"] <= quadtree.BOUND


def test_adjacency_of_edges_of_different_length(spark):
    """One long border against many short ones (T-junctions), on several grid levels."""
    named = {"long": ([([(0, 0), (64, 0), (64, 8), (0, 8)], [])], None)}
    for i in range(64):
        named[f"u{i:02d}"] = ([([(i, -1), (i + 1, -1), (i + 1, 0), (i, 0)], [])], None)
    got = {(r.geoid, r.adjacent_geoid) for r in adj.adjacency(layer(spark, named), "geoid").collect()}
    want = {("long", f"u{i:02d}") for i in range(64)} | {(f"u{i:02d}", "long") for i in range(64)}
    want |= {(f"u{i:02d}", f"u{i + d:02d}") for i in range(64) for d in (-1, 1) if 0 <= i + d < 64}
    assert got == want


def test_neighbour_lists(spark):
    named = {"a": shapes.placed(shapes._UNIT, 0, 0), "b": shapes.placed(shapes._UNIT, 1, 0), "c": shapes.placed(shapes._UNIT, 9, 9)}
    edges = adj.adjacency(layer(spark, named), "geoid")
    sites = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "id int, geoid string")
    got = {r.id: r.adjacent_id_fips for r in adj.attach_neighbours(sites, "geoid", edges).collect()}
    assert got == {1: ["b"], 2: [], 3: None}


def test_unknown_ids_stop_the_run(spark):
    known = spark.createDataFrame([("a",)], "geoid string")
    sites = spark.createDataFrame([("a",), ("zz",), (None,)], "geoid string")
    with pytest.raises(quality.DataCheckError, match="zz"):
        quality.assert_known_ids(sites, "geoid", known, "geoid")
    quality.assert_known_ids(sites.where("geoid = 'a' OR geoid IS NULL"), "geoid", known, "geoid")


def test_hot_keys_are_salted_without_changing_the_result(spark):
    left = spark.range(20_000).select("id", F.expr("if(id % 3 = 0, 7, id % 500)").alias("k"))
    right = spark.range(500).select(F.col("id").alias("k"), F.expr("id * 2").alias("v"))
    plain = left.join(right, "k").select("k", "id", "v")
    salted = joins.hot_key_join(left, right, ["k"], pairs_per_task=1000).select("k", "id", "v")
    assert "_aq_salt" in salted._jdf.queryExecution().toString()
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_repeated_rows_of_a_hot_key_are_spread(spark):
    left = spark.range(1000).select(F.lit(1).alias("k"), F.lit("a").alias("u")).union(spark.sql("SELECT 2, 'b' UNION ALL SELECT NULL, 'c'"))
    right = spark.range(300).select(F.lit(1).alias("k"), F.lit("x").alias("v")).union(spark.sql("SELECT 2, 'y' UNION ALL SELECT NULL, 'z'"))
    joined = joins.hot_key_join(left, right, ["k"], pairs_per_task=10_000)
    assert {tuple(r[:3]): r["count"] for r in joined.groupBy("k", "u", "v").count().collect()} == {(1, "a", "x"): 300_000, (2, "b", "y"): 1}
    hot = spark.sql("SELECT 1 AS k, 10L AS own, 3L AS other")
    dealt = joins.deal_rows(left, hot, ["k"], "own", "other").groupBy("own", "other").agg(F.sum("own_aq_times").alias("n")).collect()
    assert len(dealt) == 30 and {r["n"] for r in dealt} == {100}


def test_spatial_plans_use_equi_joins(spark):
    named = shapes.random_shapes(20, 10, 4)
    areas = layer(spark, named)
    points = spark.createDataFrame([(1, 2.0, 3.0)], "id int, longitude double, latitude double")
    for df in (spatial.intersect_join(points, areas, "geoid"), adj.adjacency(areas, "geoid")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for name in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
            assert name not in plan


def test_areas_of_one_partition_are_worked_on_by_all_cores(spark):
    """A layer is a short file, so one task, but every area is much work."""
    square = geo.polygon(geo.rectangle_ring(*(F.expr(v).cast("double") for v in ("id % 8", "id div 8", "id % 8 + 1", "id div 8 + 1"))))
    areas = spark.range(0, 64, 1, 1).select(F.col("id").cast("string").alias("geoid"), square.alias("geometry"))
    tasks = {}

    def store(df, name):
        tasks[name] = df.rdd.getNumPartitions()
        return sinks.write_and_reuse(df, name)

    quadtree.build_index(areas, "geoid", store=store)
    assert tasks.pop("area-cells") >= spark.sparkContext.defaultParallelism
    edges = adj.adjacency(areas, "geoid", store=store)
    assert edges.count() == 420 == edges.distinct().count()
    assert min(tasks["shapes"], tasks["area-cells"]) >= spark.sparkContext.defaultParallelism


def test_adjacency_takes_the_index_of_its_layer(spark, monkeypatch):
    """Areas are cut once; of equal areas and of rows without an id, the index holds more than the shapes compared."""
    square = geo.polygon(geo.rectangle_ring(*(F.expr(v).cast("double") for v in ("id % 4", "id % 16 div 4", "id % 4 + 1", "id % 16 div 4 + 1"))))
    areas = spark.range(20).select(F.when(F.col("id") != 19, F.col("id").cast("string")).alias("geoid"), square.alias("geometry"))
    want = {tuple(r) for r in adj.adjacency(areas, "geoid").collect()}
    assert len(want) > 84
    index = quadtree.build_index(areas, "geoid")
    monkeypatch.setattr(quadtree, "build_index", lambda *args, **kwargs: pytest.fail("cut again"))
    rows = [tuple(r) for r in adj.adjacency(areas, "geoid", index=index).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_corners_at_the_height_of_edges(spark):
    """Edges above, below and at the height of the corners of cells; a vertex on a corner, a slanted edge through one."""
    rings = {
        "square": [(0, 0), (4, 0), (4, 4), (0, 4)], "up": [(0, 0), (4, 4), (0, 4)], "down": [(0, 4), (4, 0), (4, 4)],
        "notch": [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)], "low": [(-3, -3), (5, -1), (1, 5)],
    }
    rows = [(k, [[[{"x": float(x), "y": float(y)} for x, y in r]]]) for k, r in rings.items()]
    areas = spark.createDataFrame(rows, shapes.SCHEMA).select("geoid", geo.normalise("raw").alias("geometry"))
    grid = [(x / 2 - 4, y / 2 - 4) for x in range(20) for y in range(20)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(grid)], "id int, x double, y double")
    found = spatial.locate_points(points, areas, "geoid", "x", "y")
    plain = points.crossJoin(areas.select("geoid", geo.edges("geometry").alias("edges")))
    want = plain.where(F.expr(geo.locate("x", "y", "edges")) > 0).select("x", "y", "geoid")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}
