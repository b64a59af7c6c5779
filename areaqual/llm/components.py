"""Connected components of a graph given as links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest reachable id of every node that has a link.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats and loops do not matter. Returns ``node``,
    ``component``; empty for no links. Each round joins links to one minimum per node (a unique key, so adaptive
    skew splitting serves a node with very many links) and ends when the links no longer change. The number of
    rounds grows with the logarithm of the longest chain. Nothing is gathered beyond a count and a checksum: the joins
    are merge joins, as files of links, by which Spark sizes the minima, are much smaller than the links.
    """
    links = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = _state(links)
    while True:
        links = stored(_small_star(stored(_large_star(links), "large-star")), "small-star")
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(least.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
