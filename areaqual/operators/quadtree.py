"""A quadtree over the areas of a layer, as a table of cells that meet points in an equi-join.

All areas share one lattice: the cells of level k are squares of side 2^k at whole multiples of it, so corners and cell
numbers are exact in doubles. An area starts with the cells of about its own size that its box covers. A cell through
which more than ``bound`` edges run is split in 4 x 4, again and again; what is left are

* cells with at most ``bound`` edges, kept with the cell and with the side on which its lower left corner lies,
* cells without edges inside the area, which match a point without any test.

Cells outside the area are dropped. A point is compared with the corner of its cell along a path inside the cell, so
the edges there are all that counts (:func:`areaqual.functions.geometry.locate_in_cell`).

Cells own their lower and left side. Corners are taken a little to the right and up of where they are, by less than any
coordinate can tell, the shift upwards being the smaller one; so no corner ever lies on an edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual.functions import geometry as geo
from areaqual.operators.joins import hot_key_join, spread
from areaqual.sources.sinks import Store, keep, write_and_reuse

LEVEL_CELL = ["level", "cx", "cy"]
#: Edges of a cell. Only where more edges than this meet in one point, or come closer than ``_SPLITS`` splits can
#: tell, a cell keeps more.
BOUND = 48
_BITS = 2  # levels that a split goes down
_SPLITS = 12
_INDEX_BITS = 40  # cell numbers stay far below 2^53
_SIDE = 1 << _BITS


@dataclass(frozen=True)
class AreaIndex:
    """``cells``: <area_id>, level, cx, cy, inside (of the corner: 0 or 1), edges; ``levels``: those in use."""

    cells: DataFrame
    levels: tuple[int, ...]
    area_id: str


def build_index(areas: DataFrame, area_id: str, geometry: str = "geometry", store: Store = write_and_reuse, bound: int = BOUND) -> AreaIndex:
    """The index of a layer. Build it once for a layer and hand it to every join; ``store`` writes it.

    Areas of at most ``bound`` edges are cut to cells row by row. For the others there is a round for each split that any
    of them needs, two levels at a time; in each, the edges of cells that are split are shuffled once by cell. Areas
    without edges have no cells; ids must be unique. The areas are spread first, as each is much work and few bytes.
    """
    sized = _first_level(spread(areas.select(F.col(area_id).alias("id"), F.col(geometry).alias("geometry")), "id"))
    seen = sized.agg(F.max(F.size("edges")).alias("most"), F.collect_set("level").alias("levels")).first()
    leaves = _small_leaves(sized.where(F.size("edges") <= bound))
    if (seen["most"] or 0) <= bound:
        leaves, levels = store(leaves.withColumnRenamed("id", area_id), "area-cells"), seen["levels"]
        return AreaIndex(leaves, tuple(sorted(levels)), area_id)
    rounds = write_and_reuse if store is keep else store  # each builds on the one before
    large = _split_leaves(rounds(sized.where(F.size("edges") > bound), "sized-areas"), rounds, bound)
    leaves = rounds(leaves.unionByName(large).withColumnRenamed("id", area_id), "area-cells")
    levels = sorted(r["level"] for r in leaves.select("level").distinct().collect())  # a few dozen at most
    return AreaIndex(leaves, tuple(levels), area_id)


def _small_leaves(sized: DataFrame) -> DataFrame:
    """Cells of areas with few edges: those of their boxes, each with the edges that run through it."""
    placed = sized.select("id", "level", "edges", "ly", "hy", F.expr("explode(sequence(lx, hx))").alias("cx")).select(
        "id", "level", "edges", "cx", F.expr("explode(sequence(ly, hy))").alias("cy"), F.expr("pow(2D, level)").alias("size")
    )
    box = " AND ".join(f"c{c} BETWEEN floor(least(e.{c}0, e.{c}1) / size) AND floor(greatest(e.{c}0, e.{c}1) / size)" for c in "xy")
    through = f"filter(edges, e -> (e.x0 != e.x1 OR e.y0 != e.y1) AND {box} AND {_NEAR})"
    # Only an edge at the height of the corner needs its exact side.
    side = f"{geo.shifted_side('e', 'cx * size', 'cy * size')} * sign(e.x1 - e.x0) < 0D"
    above = f"""(e.x0 > cx * size) != (e.x1 > cx * size) AND greatest(e.y0, e.y1) >= cy * size
        AND (least(e.y0, e.y1) > cy * size OR {side})"""
    cells = placed.select(
        "id", *LEVEL_CELL, F.expr(f"size(filter(edges, e -> {above})) % 2").cast("int").alias("inside"),
        F.expr(f"transform({through}, e -> struct(e.x0, e.y0, e.x1, e.y1))").cast(_EDGES).alias("edges"),
    )
    return cells.where("inside = 1 OR size(edges) > 0")


def _split_leaves(sized: DataFrame, store: Store, bound: int) -> DataFrame:
    """Cells of areas with many edges, split until they hold at most ``bound``."""
    cells = sized.select("id", "level", F.expr("explode(sequence(lx, hx))").alias("cx"), "ly", "hy").select(
        "id", "level", "cx", F.expr("explode(sequence(ly, hy))").alias("cy")
    )
    edges = sized.select("id", "level", "ly", F.expr("inline(edges)")).where("x0 != x1 OR y0 != y1")
    edges = edges.select("id", "level", "ly", F.expr("struct(x0, y0, x1, y1) AS e"), F.expr("pow(2D, level)").alias("size"))
    corners = _below(edges).groupBy("id", *LEVEL_CELL).agg((F.count(F.lit(1)) % 2).cast("int").alias("inside"))
    cells = cells.join(corners, ["id", *LEVEL_CELL], "left").fillna(0, ["inside"])
    touched = _touched(edges, "floor(least(e.x0, e.x1) / size)", "floor(greatest(e.x0, e.x1) / size)",
                       "floor(least(e.y0, e.y1) / size)", "floor(greatest(e.y0, e.y1) / size)")
    leaves = None
    for step in range(_SPLITS + 1):
        touched = store(touched, "cell-edges")
        counts = touched.groupBy("id", *LEVEL_CELL).agg(F.count(F.lit(1)).alias("n"))
        known = store(cells.join(counts, ["id", *LEVEL_CELL], "left").fillna(0, ["n"]), "cells")
        many = known.where(F.col("n") > bound) if step < _SPLITS else known.limit(0)
        few = known.join(many.select("id", *LEVEL_CELL), ["id", *LEVEL_CELL], "left_anti")
        found = _leaves(few, touched)
        leaves = found if leaves is None else leaves.unionByName(found)
        if many.isEmpty():
            return leaves
        cells, touched = _split(many, touched)
    return leaves


def _first_level(areas: DataFrame) -> DataFrame:
    """Edges, level and the range of cells of every area: cells of a quarter of its extent to all of it."""
    with_edges = areas.select("id", geo.edges("geometry").alias("edges")).where("size(edges) > 0")
    boxed = with_edges.select(
        "id", "edges", *[F.expr(f"array_{f}(transform(edges, e -> e.{c}0))").alias(f"{f}_{c}") for c in "xy" for f in ("min", "max")]
    )
    extent = "greatest(max_x - min_x, max_y - min_y)"
    fitting = f"{_BITS} * floor(log2({extent}) / {_BITS})"
    finest = f"{_BITS} * ceil((log2(greatest(abs(min_x), abs(max_x), abs(min_y), abs(max_y))) - {_INDEX_BITS}) / {_BITS})"
    levelled = boxed.withColumn("level", F.expr(f"cast(coalesce(greatest({fitting}, {finest}), 0) as int)"))
    at = {"lx": "min_x", "hx": "max_x", "ly": "min_y", "hy": "max_y"}
    return levelled.select("id", "edges", "level", *[F.expr(f"floor({v} / pow(2D, level))").alias(k) for k, v in at.items()])


def _below(edges: DataFrame) -> DataFrame:
    """A row for each edge and each corner of the area's cells straight below it."""
    columns = F.expr("explode(sequence(floor(least(e.x0, e.x1) / size), floor(greatest(e.x0, e.x1) / size)))")
    crossed = edges.select("*", columns.alias("cx")).where("(e.x0 > cx * size) != (e.x1 > cx * size)")
    rows = F.expr("explode(sequence(ly, greatest(ly, floor(greatest(e.y0, e.y1) / size))))")
    side = geo.shifted_side("e", "cx * size", "cy * size")
    return crossed.select("*", rows.alias("cy")).where(F.expr(f"{side} * sign(e.x1 - e.x0) < 0D"))


def _touched(edges: DataFrame, lx: str, hx: str, ly: str, hy: str) -> DataFrame:
    """``id, level, cx, cy, e`` for the cells that an edge may run through: those of its box that its line comes near."""
    columns = edges.select("*", F.expr(f"explode(sequence({lx}, {hx}))").alias("cx"))
    boxes = columns.select("*", F.expr(f"explode(sequence({ly}, {hy}))").alias("cy"))
    return boxes.where(_NEAR).select("id", *LEVEL_CELL, "e")


# The distance of a cell's middle from the line against that of the corner farthest from it, with room for rounding.
_NEAR = """abs(((cx + 0.5D) * size - e.x0) * (e.y1 - e.y0) - ((cy + 0.5D) * size - e.y0) * (e.x1 - e.x0))
    <= size * 0.500001D * (abs(e.x1 - e.x0) + abs(e.y1 - e.y0))"""


def _leaves(cells: DataFrame, touched: DataFrame) -> DataFrame:
    """Cells that stay: inside the area without edges, or with their edges."""
    inner = cells.where("n = 0 AND inside = 1").select("id", *LEVEL_CELL, "inside", F.expr("array()").cast(_EDGES).alias("edges"))
    lists = (
        touched.join(cells.where("n > 0").select("id", *LEVEL_CELL, "inside"), ["id", *LEVEL_CELL])
        .groupBy("id", *LEVEL_CELL, "inside")
        .agg(F.collect_list("e").alias("edges"))
    )
    return inner.unionByName(lists)


_EDGES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def _split(cells: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells two levels down, each with the side of its corner, and the edges that run through them."""
    size = F.expr(f"pow(2D, level - {_BITS})")
    edges = touched.join(cells.select("id", *LEVEL_CELL), ["id", *LEVEL_CELL], "left_semi").withColumn("size", size)
    flips = edges.groupBy("id", *LEVEL_CELL).agg(F.bit_xor(F.expr(_flipped())).alias("flips"))
    below = F.expr(f"explode(sequence(0, {_SIDE * _SIDE - 1}))").alias("k")
    made = cells.join(flips, ["id", *LEVEL_CELL]).select("id", *LEVEL_CELL, "inside", "flips", below)
    children = made.select(
        "id", (F.col("level") - _BITS).alias("level"), F.expr(f"cx * {_SIDE} + k % {_SIDE}").alias("cx"),
        F.expr(f"cy * {_SIDE} + k div {_SIDE}").alias("cy"), F.expr("cast(inside ^ (shiftright(flips, k) & 1) as int)").alias("inside"),
    )
    inside_cell = edges.select(
        "id", (F.col("level") - _BITS).alias("level"), "e", "size", F.col("cx").alias("px"), F.col("cy").alias("py")
    )
    spans = [
        f"{f}(p{c} * {_SIDE}{more}, floor({f2}(e.{c}0, e.{c}1) / size))"
        for c in "xy" for f, f2, more in (("greatest", "least", ""), ("least", "greatest", f" + {_SIDE - 1}"))
    ]
    return children, _touched(inside_cell, *spans)


def _flipped() -> str:
    """Bits of the corners in a cell that lie across the edge, seen along the path from the cell's own corner: along its
    lower side, then straight up. ``size`` is that of the smaller cells."""
    left, low = f"(cx * {_SIDE} * size)", f"(cy * {_SIDE} * size)"
    side = geo.shifted_side("e", f"({left} + (k % {_SIDE}) * size)", f"({low} + (k div {_SIDE}) * size)")
    sides = f"transform(sequence(0, {_SIDE * _SIDE - 1}), k -> {side})"
    along = f"(e.y0 > {low}) != (e.y1 > {low}) AND s.v[0] != s.v[k % {_SIDE}]"
    column = f"({left} + (k % {_SIDE}) * size)"
    up = f"(e.x0 > {column}) != (e.x1 > {column}) AND s.v[k % {_SIDE}] != s.v[k]"
    bits = f"""aggregate(sequence(0, {_SIDE * _SIDE - 1}), 0,
        (m, k) -> m | shiftleft(cast({along} as int) ^ cast({up} as int), k))"""
    apart = f"ceil(e.x0 / size) != ceil(e.x1 / size) OR (e.y0 > {low}) != (e.y1 > {low})"
    return f"CASE WHEN {apart} THEN {geo.bind({'v': sides}, 's', bits)} ELSE 0 END"


def point_cells(points: DataFrame, levels: tuple[int, ...], x: str, y: str) -> DataFrame:
    """The points, once for each level in use, with the cell they lie in."""
    if not levels:
        return points.select("*", *[F.lit(0).cast(t).alias(n) for n, t in (("level", "int"), ("cx", "long"), ("cy", "long"))]).limit(0)
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(2.0**k).alias("size")) for k in levels]))
    placed = points.withColumn("at", at)
    cell = [F.expr(f"floor({v} / at.size)").alias(n) for v, n in ((x, "cx"), (y, "cy"))]
    return placed.select(*points.columns, F.col("at.level").alias("level"), *cell)


def locate(points: DataFrame, index: AreaIndex, x: str, y: str, match: dict[str, str] | None = None, store: Store = keep) -> DataFrame:
    """The columns of ``points`` with ``<area_id>`` and ``place`` (INSIDE or ON_BORDER) of every area that each lies in.

    ``match`` names columns of ``points`` that must equal columns of the index, so that a point meets one area alone;
    without it cells that many areas or points share are dealt to several tasks.
    """
    probes = store(point_cells(points, index.levels, x, y), "probes")
    if match:
        cells = index.cells.withColumnsRenamed({c: p for p, c in match.items()})
        met = probes.join(cells, [*match, *LEVEL_CELL])
    else:
        met = hot_key_join(probes, index.cells, LEVEL_CELL, store=store)
    place = geo.locate_in_cell(x, y, "edges", "inside", "cx * pow(2D, level)", "cy * pow(2D, level)")
    kept = [*points.columns] if match else [*points.columns, index.area_id]
    return met.select(*kept, F.expr(place).alias("place")).where(F.col("place") > geo.OUTSIDE)
