"""Exact top-k by inner product with KD-trees per shard.

Rows are dealt to shards of bounded size; each shard has a KD-tree with median splits and the tight bounding box of
every node. A query meets the shard it lies in first; the k-th score it finds there goes with it to all other
shards, where whole trees, branches and leaves that cannot reach it are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaqual.llm.common import only, ship, stored
from areaqual.llm.vectors import is_finite

RESULT = "query_id long, vec_id long, score long"
ship(__name__)


class Tree:
    """A KD-tree over whole numbers: nodes as arrays, the points in the order of the leaves."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int) -> None:
        order, self.low, self.high, self.child, self.span = np.arange(len(ids)), [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            held, node = points[order[a:b]], len(self.low)
            self.low.append(held.min(axis=0))
            self.high.append(held.max(axis=0))
            self.span.append((a, b))
            self.child.append([])
            if parent >= 0:
                self.child[parent].append(node)
            if b - a > leaf and held.shape[1]:
                widest = int((self.high[-1] - self.low[-1]).argmax())
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(held[:, widest], middle)]
                todo += [(a, a + middle, node), (a + middle, b, node)]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that a point in each node's box could have with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but ``own``, those under ``least`` left out; nodes by falling bound."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.points.dtype)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if self.child[node]:
                for c in self.child[node]:
                    heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.span[node]
            found = self.points[a:b] @ query
            good = (found >= least) & (self.ids[a:b] != own)
            if good.any():
                ids, scores = np.concatenate([ids, self.ids[a:b][good]]), np.concatenate([scores, found[good]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = max(least, scores[-1])
        return ids, scores


def whole_numbers(column: pd.Series, most: int) -> np.ndarray:
    """Rows as floats if their inner products with numbers up to ``most`` are exact in them, else as Python integers."""
    values = column.tolist()
    size = len(values[0]) if values else 0
    large = max((max(abs(int(v.min())), abs(int(v.max()))) for v in values if size), default=0)
    exact = max(large, most) ** 2 * max(size, 1) < 1 << 53
    return np.array([v.tolist() for v in values], np.float64 if exact else object).reshape(len(values), size)


def _largest(column: pd.Series) -> int:
    return max((max(abs(int(v.min())), abs(int(v.max()))) for v in column if len(v)), default=0)


def _cell(points: pd.DataFrame, queries: pd.DataFrame, k: int, leaf: int) -> pd.DataFrame:
    """What the queries find in one shard. Vectors of another length are no candidates."""
    out = []
    points, queries = points.assign(n=points["q"].map(len)), queries.assign(n=queries["vector"].map(len))
    for n, asked in queries.groupby("n"):
        held = points[points["n"] == n]
        if held.empty:
            continue
        most = max(_largest(held["q"]), _largest(asked["vector"]))
        tree = Tree(held["vec_id"].to_numpy(np.int64), whole_numbers(held["q"], most), leaf)
        vectors = whole_numbers(asked["vector"], most)
        bounds = tree.bounds(vectors)
        for k_th, (own, least) in enumerate(zip(asked["query_id"].to_numpy(np.int64), asked["least"], strict=True)):
            ids, scores = tree.search(vectors[k_th], own, bounds[k_th], k, int(least))
            if len(ids):
                clipped = [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": np.array(clipped, np.int64)}))
    if not out:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
    return pd.concat(out)


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and q, the components floor(scale * x) of every finite vector.

    One row for each id: of rows with the same id the smallest vector counts. Rows without an id take no part.
    """
    x = F.col("embedding")
    rows = only(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & is_finite(x))
    q = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return rows.select(F.col("vec_id").cast("long"), q.alias("q")).groupBy("vec_id").agg(F.min("q").alias("q"))


def top_k(
    numbers: DataFrame, is_query: Column, k: int = 20, shard_rows: int = 8192, block_rows: int = 2048, leaf: int = 256
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query, ties to the smaller id.

    ``numbers`` has vec_id and q (whole numbers, see ``quantized``), ``is_query`` marks the queries; every row but the
    query's own is a candidate. Work is the product of queries and rows, in cells of one shard by one block of
    queries, so that neither side is ever whole in a task, nor in the driver. Scores beyond a long are cut to it.
    A query without candidates has no row; an empty table gives an empty result.
    """
    held = stored(numbers.select("vec_id", "q", is_query.alias("asks")), "numbers")
    rows, asked = held.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-asked // block_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    points = held.select(shard.alias("shard"), "vec_id", "q")
    queries = held.filter("asks").select(
        shard.alias("home"), block.alias("block"), F.col("vec_id").alias("query_id"), F.col("q").alias("vector")
    )

    def cell(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _cell(points, queries, k, leaf)

    none = F.lit(-(1 << 63)).cast("long")
    first = stored(
        points.groupBy("shard").cogroup(
            queries.select(F.col("home").alias("shard"), "query_id", "vector", none.alias("least")).groupBy("shard")
        ).applyInPandas(cell, RESULT),
        "home",
    )
    known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    least = F.when(F.col("n") >= k, F.col("kth")).otherwise(none).alias("least")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))).alias("shard")
    rest = queries.join(known, "query_id", "left").select("block", "query_id", "vector", least, others)
    copies = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    second = copies.groupBy("shard", "block").cogroup(rest.groupBy("shard", "block")).applyInPandas(cell, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionAll(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
