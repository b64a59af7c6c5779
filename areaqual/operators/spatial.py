"""Point-in-area joins as equi-joins on the cells of a quadtree.

Sites are reduced to distinct coordinates first and meet the cells of :mod:`areaqual.operators.quadtree`, each with a
bounded number of edges; the wide site rows are shuffled once, for the final join back. The grid of
this module serves joins of edges with edges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaqual.operators import quadtree
from areaqual.operators.quadtree import AreaIndex
from areaqual.sources.sinks import Store
from areaqual.sources.sinks import keep as keep_unstored

CELL = ["level", "cx", "cy"]
_STEP = 4.0


@dataclass(frozen=True)
class Grid:
    """Cell sizes by level, coarse ones for large shapes."""

    sizes: tuple[float, ...]
    used: tuple[int, ...]

    def level_of(self, extent: Column, cells_per_side: float) -> Column:
        """Finest level on which a shape of this extent spans about ``cells_per_side`` cells."""
        level = F.lit(len(self.sizes) - 1)
        for k in range(len(self.sizes) - 2, -1, -1):
            level = F.when(extent <= self.sizes[k] * cells_per_side, k).otherwise(level)
        return level

    def size_at(self, level: Column) -> Column:
        return F.element_at(F.array(*[F.lit(s) for s in self.sizes]), level + 1)


def fit_grid(shapes: DataFrame, extent: Column, cells_per_side: float) -> Grid:
    """Choose cell sizes from the extents of the shapes; two small aggregates, at most 25 rows.

    The finest level fits the smallest hundredth of the shapes, each level is four times coarser.
    """
    sized = shapes.select(extent.alias("extent")).where("extent > 0")
    stats = sized.agg(F.percentile_approx("extent", 0.01).alias("low"), F.max("extent").alias("high")).first()
    if stats["low"] is None:
        return Grid((1.0,), (0,))
    base = stats["low"] / cells_per_side
    steps = math.ceil(math.log(max(stats["high"] / (base * cells_per_side), 1.0), _STEP))
    sizes = tuple(base * _STEP**k for k in range(min(steps, 24) + 1))
    grid = Grid(sizes, (0,))
    if len(sizes) == 1:
        return grid
    levels = sized.select(grid.level_of(F.col("extent"), cells_per_side).alias("level")).distinct().collect()
    return Grid(sizes, tuple(sorted(r["level"] for r in levels)))


def cell(value: str, size: str) -> str:
    return f"CAST(floor({value} / {size}) AS BIGINT)"


def locate_points(
    points: DataFrame, areas: DataFrame, area_id: str, x: str, y: str, geometry: str = "geometry",
    index: AreaIndex | None = None, store: Store = keep_unstored,
) -> DataFrame:
    """Distinct ``(x, y, area_id)`` where the point lies in the area or on its border.

    The distinct probes are counted and joined; ``store`` writes them in between.
    """
    index = index or quadtree.build_index(areas, area_id, geometry, store)
    known = points.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(
        f"{x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({x}) AND NOT isnan({y})"
    )
    return quadtree.locate(known.distinct(), index, x, y, store=store).select(x, y, F.col(index.area_id).alias(area_id))


def intersect_join(
    sites: DataFrame, areas: DataFrame, area_id: str, x: str = "longitude", y: str = "latitude",
    keep: Sequence[str] = (), geometry: str = "geometry", index: AreaIndex | None = None, store: Store = keep_unstored,
) -> DataFrame:
    """Left join of sites to the areas they intersect.

    A site on a shared border yields one row per area; a site outside all areas stays with nulls.
    ``keep`` names further area columns; pass the geometry there only when the caller needs it.
    """
    found = locate_points(sites, areas, area_id, x, y, geometry, index, store).withColumnsRenamed(
        {x: "_aq_x", y: "_aq_y"}
    )
    joined = sites.join(found, (F.col(x) == F.col("_aq_x")) & (F.col(y) == F.col("_aq_y")), "left").drop("_aq_x", "_aq_y")
    return joined.join(areas.select(area_id, *keep), area_id, "left") if keep else joined
