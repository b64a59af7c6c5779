"""Which areas touch: they share border points and their interiors are apart.

The layer is turned into an edge table ``(geoid, adjacent_geoid)`` that is built once and stored.
Corner contact counts, an area does not touch itself, overlapping or nested areas do not touch.

1. Areas with identical geometry are represented by one of them.
2. Border edges meet through an equi-join on grid cells that fit the edge length: the finer edge of
   a pair looks for the coarser one, and only the cell that holds the lower left corner of their
   common box reports the pair. Pairs whose boxes are apart never leave the join.
3. Each contact is a position or a stretch along the edge. Edges that cross, or run together in the
   same direction, mean that the interiors meet.
4. What remains of an edge between contacts is tested by its middle against the other area, through the quadtree of
   the layer; so is a vertex of every ring, which must not lie inside an area that its ring has no contact with.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual.functions import geometry as geo
from areaqual.operators import quadtree
from areaqual.operators.joins import hot_key_join, spread
from areaqual.operators.quadtree import AreaIndex
from areaqual.operators.spatial import CELL, Grid, cell, fit_grid
from areaqual.sources.sinks import Store, write_and_reuse

_CELLS_PER_EDGE = 1.0
#: Pieces shorter than this part of their edge are rounding between two contacts, not a stretch to be tested.
_SHORTEST_PIECE = "1e-9D"
_EDGE = "ring, pos, x0, y0, x1, y1"
_EDGE_EXTENT = "greatest(abs(x1 - x0), abs(y1 - y0))"


def representatives(areas: DataFrame, area_id: str, geometry: str = "geometry") -> DataFrame:
    """``(member, shape)``: the smallest id among the areas with exactly the same geometry."""
    keyed = areas.select(
        F.col(area_id).alias("member"), F.sha2(F.to_json(F.col(geometry)), 256).alias("digest")
    ).where("member IS NOT NULL AND digest IS NOT NULL")
    first = keyed.groupBy("digest").agg(F.min("member").alias("shape"))
    return keyed.join(first, "digest").select("member", "shape")


def adjacency(
    areas: DataFrame, area_id: str, geometry: str = "geometry", grid: Grid | None = None, store: Store = write_and_reuse,
    index: AreaIndex | None = None,
) -> DataFrame:
    """Edge table ``(area_id, adjacent_<area_id>)`` of a layer, both directions of every pair.

    Shapes, contacts and cells are read in several steps; ``store`` writes each once. Shapes are stored spread, so that the
    steps on their edges are tasks for all cores. ``index`` is that of the layer, if there is one, so that areas are not cut twice.
    """
    groups = store(representatives(areas, area_id, geometry), "shape-groups")
    only_shapes = groups.where("member = shape").select("shape")
    shapes = areas.select(F.col(area_id).alias("shape"), F.col(geometry).alias("geometry")).join(
        only_shapes, "shape", "left_semi"
    )
    if index:
        cells = index.cells.withColumnRenamed(index.area_id, "shape").join(only_shapes, "shape", "left_semi")
        index = replace(index, cells=cells, area_id="shape")
    pairs = touching_shapes(store(spread(shapes, "shape"), "shapes"), grid, store, index)
    return (
        pairs.join(groups.withColumnsRenamed({"shape": "id", "member": area_id}), "id")
        .join(groups.withColumnsRenamed({"shape": "other", "member": f"adjacent_{area_id}"}), "other")
        .select(area_id, f"adjacent_{area_id}")
    )


def touching_shapes(
    shapes: DataFrame, grid: Grid | None = None, store: Store = write_and_reuse, index: AreaIndex | None = None
) -> DataFrame:
    """``(id, other)`` in both directions, for distinct shapes ``(shape, geometry)``, of which ``index`` is the index.

    Contacts, tests and findings are rows throughout; no row holds more edges than a cell of the quadtree.
    """
    edges = shapes.select(F.col("shape").alias("id"), F.inline(geo.edges("geometry"))).where("x0 != x1 OR y0 != y1")
    grid = grid or fit_grid(edges, F.expr(_EDGE_EXTENT), _CELLS_PER_EDGE)
    index = index or quadtree.build_index(shapes, "shape", store=store)
    starts = shapes.select(F.col("shape").alias("id"), F.inline(geo.ring_starts("geometry")))

    contacts = store(_by_edge(_contacts(_edge_pairs(edges, grid))), "contacts")
    crossed = contacts.where(F.col("worst") >= geo.SHARED_ALIGNED).select("id", "other")
    middles = contacts.where(F.col("worst") < geo.SHARED_ALIGNED).select("id", "other", F.expr(f"inline({_PIECES})"))
    inside = quadtree.locate(middles.distinct(), index, "x", "y", {"other": "shape"})
    # Few areas hold a given vertex, so this is as long as there are rings, whatever the number of neighbours.
    holding = quadtree.locate(starts, index, "x", "y").withColumnRenamed("shape", "other")
    apart = holding.where("id != other").join(contacts.select("id", "other", "ring"), ["id", "other", "ring"], "left_anti")
    meeting = crossed
    for found in (inside, apart):
        meeting = meeting.unionByName(found.where(F.col("place") == geo.INSIDE).select("id", "other"))
    unordered = [F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")]
    touching = contacts.select(*unordered).distinct().join(meeting.select(*unordered), ["a", "b"], "left_anti")
    return touching.select(F.expr("inline(array(named_struct('id', a, 'other', b), named_struct('id', b, 'other', a)))"))


def _edge_pairs(edges: DataFrame, grid: Grid) -> DataFrame:
    """Pairs of edges ``(a, b)`` of different areas whose boxes meet, each pair once."""
    home_level = grid.level_of(F.expr(_EDGE_EXTENT), _CELLS_PER_EDGE)
    edge = edges.select("id", F.expr(f"struct({_EDGE}) AS e"), home_level.alias("home"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(grid.sizes[k]).alias("size")) for k in grid.used])
    probe = _edge_cells(edge.withColumn("at", F.explode(levels)).where("at.level >= home"))
    target = _edge_cells(edge.withColumn("at", F.explode(levels)).where("at.level = home"))
    left = probe.withColumnsRenamed({"id": "id_a", "e": "a", "home": "home_a"})
    right = target.select(*CELL, F.col("id").alias("id_b"), F.col("e").alias("b"))
    corner_x = "greatest(least(a.x0, a.x1), least(b.x0, b.x1))"
    corner_y = "greatest(least(a.y0, a.y1), least(b.y0, b.y1))"
    return (
        hot_key_join(left, right, CELL)
        .where("id_a != id_b AND (home_a < level OR id_a < id_b)")
        .where(f"{corner_x} <= least(greatest(a.x0, a.x1), greatest(b.x0, b.x1))")
        .where(f"{corner_y} <= least(greatest(a.y0, a.y1), greatest(b.y0, b.y1))")
        .where(f"{cell(corner_x, 'size')} = cx AND {cell(corner_y, 'size')} = cy")
        .select("id_a", "a", "id_b", "b")
    )


def _edge_cells(placed: DataFrame) -> DataFrame:
    """Cells under the box of every edge, ``size`` kept for the corner test."""

    def span(u: str, v: str) -> str:
        return f"explode(sequence({cell(f'least({u}, {v})', 'at.size')}, {cell(f'greatest({u}, {v})', 'at.size')}))"

    across = placed.withColumn("cx", F.expr(span("e.x0", "e.x1")))
    return across.withColumn("cy", F.expr(span("e.y0", "e.y1"))).select(
        "id", "e", "home", F.col("at.level").alias("level"), "cx", "cy", F.col("at.size").alias("size")
    )


def _contacts(pairs: DataFrame) -> DataFrame:
    """Contacts seen from both edges: ``id, other, <edge>, lo, hi, kind``."""
    signs = pairs.withColumns(geo.turn_signs("a", "b"))
    seen = f"""
        inline(filter(array(
          named_struct('id', id_a, 'other', id_b, 'e', a, 'c', {geo.contact('a', 'b', 'a0', 'a1', 'b0', 'b1')}),
          named_struct('id', id_b, 'other', id_a, 'e', b, 'c', {geo.contact('b', 'a', 'b0', 'b1', 'a0', 'a1')})
        ), s -> s.c IS NOT NULL))"""
    return signs.select(F.expr(seen)).select("id", "other", "e", "c.lo", "c.hi", "c.kind")


def _by_edge(contacts: DataFrame) -> DataFrame:
    """Per edge and other area: the ring, the worst contact, all contacts in order and where they cut the edge."""
    per_edge = contacts.groupBy("id", "other", "e").agg(
        F.max("kind").alias("worst"), F.sort_array(F.collect_set(F.struct("lo", "hi", "kind"))).alias("found")
    )
    cuts = "sort_array(array_distinct(concat(array(0D, 1D), transform(found, c -> c.lo + 0D), transform(found, c -> c.hi + 0D))))"
    return per_edge.select("id", "other", "e", "e.ring", "worst", "found", F.expr(cuts).alias("cuts"))


_PIECES = f"""
    transform(
      filter(zip_with(slice(cuts, 1, size(cuts) - 1), slice(cuts, 2, size(cuts) - 1),
                      (u, v) -> named_struct('m', (u + v) / 2D, 'length', v - u)),
             piece -> piece.length > {_SHORTEST_PIECE}
               AND NOT exists(found, c -> c.kind = {geo.SHARED_OPPOSED} AND c.lo <= piece.m AND piece.m <= c.hi)),
      piece -> named_struct('x', e.x0 + piece.m * (e.x1 - e.x0), 'y', e.y0 + piece.m * (e.y1 - e.y0)))"""


def attach_neighbours(
    df: DataFrame, id_column: str, adjacent: DataFrame, name: str = "adjacent_id_fips"
) -> DataFrame:
    """Add the sorted list of neighbours of each row's area; an area without any gets an empty list.

    The list is as long as an area has neighbours. The rules use the edge table itself.
    """
    wanted = df.select(id_column).where(F.col(id_column).isNotNull()).distinct()
    lists = (
        wanted.join(adjacent, id_column, "left")
        .groupBy(id_column)
        .agg(F.sort_array(F.collect_list(f"adjacent_{id_column}")).alias(name))
    )
    return df.join(lists, id_column, "left")
