"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of a label are dealt to overlapping clusters; each cluster, in shards of bounded size, gets a graph whose
edges are pruned robustly; the adjacency lists of a vector are united. Every vector is then searched from the medoid
of each shard of its cluster; where the greedy search meets a vector in range it goes on through all neighbours in
range. Every hit is verified by its cosine, and the share of links found is measured against brute force. Within a shard,
which is bounded, similarities are one matrix product, and pruning and search go on for all vectors together.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaqual.llm.common import only, ship, stored
from areaqual.llm.components import connected_components
from areaqual.llm.vectors import is_finite, matrix, parts_needed

ship(__name__)


@dataclass(frozen=True)
class Settings:
    least: float = 0.98  # cosine of a link
    cluster_rows: int = 1024  # wanted size of a cluster
    max_centres: int = 4096  # of all labels; they are a bounded sample and reach the driver
    overlap: float = 0.2  # a vector joins its two nearest clusters and all that are so much less similar
    shard_rows: int = 2048  # of a cluster that is larger, in each shard and block of queries
    degree: int = 24
    build_width: int = 40
    search_width: int = 64
    alpha: float = 1.2
    slack: float = 0.01  # so far below the least cosine the search still goes on
    audit_rows: int = 1000  # vectors whose links brute force counts
    recall: float = 0.9  # that is wanted


# --- the graph of one shard ---------------------------------------------------------------------


def robust_prune(s: np.ndarray, at: np.ndarray, others: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Marks what each node of ``at`` keeps of its row of ``others`` (nearest first, ended by -1), ``degree`` at most.

    Nearest first; one falls away if a kept one is nearer to it by more than the factor alpha. ``s`` has the similarity of
    all nodes. All rows go on together, place by place.
    """
    count, wide, flat = np.zeros(len(at), np.int64), others.shape[1], s.reshape(-1)
    others = np.ascontiguousarray(others.T)
    held, row = others >= 0, others * s.shape[1]
    apart = 1 - s[at, others]  # half the squared distance
    kept = np.zeros(others.shape, bool)
    for factor in (1.0, alpha * alpha):  # first the few that point every way, then more
        open_, bound, before = held & ~kept, 1 - apart / factor, kept.any(axis=1)
        for k in np.flatnonzero(before):
            r = np.flatnonzero(kept[k] & (count < degree))
            open_[:, r] &= flat[row[k, r] + others[:, r]] < bound[:, r]
        for k in range(wide):
            r = np.flatnonzero(open_[k] & (count < degree))
            if len(r):
                kept[k, r] = True
                count[r] += 1
                open_[k + 1 :, r] &= flat[row[k, r] + others[k + 1 :, r]] < bound[k + 1 :, r]
    return kept.T


def build(x: np.ndarray, s: Settings, at_once: int = 512) -> tuple[np.ndarray, np.ndarray, int]:
    """Edges as two arrays, sorted by the first, and the medoid.

    The medoid comes first, then the others in order. Each gets edges to some of the ``build_width`` nearest that came
    before it, and those get one back; lists of over twice the degree are pruned.
    """
    n = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    order = np.concatenate([[medoid], np.delete(np.arange(n), medoid)])
    like = x[order] @ x[order].T
    lists = np.full((n, s.build_width), -1)
    for begin in range(1, n, at_once):
        rows = np.arange(begin, min(begin + at_once, n))
        near = np.where(np.arange(rows[-1]) < rows[:, None], like[rows, : rows[-1]], -np.inf)
        wide = min(s.build_width, near.shape[1])
        found = np.argpartition(near, near.shape[1] - wide, axis=1)[:, near.shape[1] - wide :]
        value = np.take_along_axis(near, found, 1)
        by = np.argsort(-value, axis=1, kind="stable")
        found = np.where(np.take_along_axis(value, by, 1) > -np.inf, np.take_along_axis(found, by, 1), -1)
        lists[rows, :wide] = np.where(robust_prune(like, rows, found, s.degree, s.alpha), found, -1)
    a, place = np.nonzero(lists >= 0)
    b = lists[a, place]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.lexsort((-like[a, b], a))
    a, b = a[by], b[by]
    size = np.bincount(a, minlength=n)
    begin, kept = np.cumsum(size) - size, np.ones(len(a), bool)
    full = np.flatnonzero(size > 2 * s.degree)
    full = full[np.argsort(size[full], kind="stable")]
    while len(full):  # of about one size at a time
        rows = full[: max(1, int((size[full] * np.arange(1, len(full) + 1) <= 1 << 14).sum()))]
        full = full[len(rows) :]
        spot = np.arange(size[rows].max())
        held = spot < size[rows, None]
        spot = np.where(held, begin[rows, None] + spot, 0)
        kept[spot[held]] = robust_prune(like, rows, np.where(held, b[spot], -1), s.degree, s.alpha)[held]
    a, b = order[a[kept]], order[b[kept]]
    by = np.argsort(a, kind="stable")
    return a[by], b[by], medoid


def in_range(like: np.ndarray, near: np.ndarray, starts: list[int], s: Settings, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and node of ``least`` or more: greedy search, then on through the neighbours of everything in range.

    ``like`` has a row of similarities for each query, ``near`` a row of neighbours for each node, filled up with the number
    of nodes. The queries go on together; each looks at the neighbours of the best ``steps`` of its ``search_width`` best
    so far that it has not looked at yet, until there are none, all in ``flat`` places of query and node.
    """
    q, n = like.shape
    width = min(max(s.search_width, len(starts)), n)
    steps = max(steps, width // 16)
    like = np.concatenate([like, np.full((q, 1), -np.inf)], axis=1).reshape(-1)
    seen, tag = np.zeros((q, n + 1), bool), np.zeros(q * (n + 1), np.int64)
    seen[:, n] = True
    seen = seen.reshape(-1)

    def look(flat: np.ndarray) -> np.ndarray:
        """Those not seen before, each once and in order."""
        flat = flat.compress(~seen.take(flat))
        tag[flat] = number = np.arange(len(flat))
        flat = flat.compress(tag.take(flat) == number)
        seen[flat] = True
        return flat

    def beside(at: np.ndarray, node: np.ndarray) -> np.ndarray:
        return look((at[:, None] * (n + 1) + near.take(node, axis=0)).reshape(-1))

    value, node, todo = np.full((q, width), -np.inf), np.full((q, width), n), np.zeros((q, width), bool)
    fresh, close = look((np.arange(q)[:, None] * (n + 1) + np.array(starts)).reshape(-1)), []
    while True:
        v, at = like.take(fresh), fresh // (n + 1)
        close.append(fresh[v >= s.least - s.slack])
        better = v > value[at, -1]
        if better.any():
            v, at, k = v[better], at[better], fresh[better] % (n + 1)
            rows, begin, size = np.unique(at, return_index=True, return_counts=True)
            line, place = np.repeat(np.arange(len(rows)), size), width + np.arange(len(at)) - np.repeat(begin, size)
            blank = ((0, 0), (0, int(size.max())))
            all_v, all_k = np.pad(value[rows], blank, constant_values=-np.inf), np.pad(node[rows], blank, constant_values=n)
            all_todo = np.pad(todo[rows], blank)
            all_v[line, place], all_k[line, place], all_todo[line, place] = v, k, True
            best = np.argsort(-all_v, axis=1, kind="stable")[:, :width]
            value[rows], node[rows] = np.take_along_axis(all_v, best, 1), np.take_along_axis(all_k, best, 1)
            todo[rows] = np.take_along_axis(all_todo, best, 1)
        at, place = np.nonzero(todo & (np.cumsum(todo, axis=1) <= steps))
        if not len(at):
            break
        todo[at, place] = False
        fresh = beside(at, node[at, place])
    hits, most = [], max(1, (1 << 21) // near.shape[1])
    front = np.concatenate(close)
    while len(front):
        hits.append(front[like[front] >= s.least])
        found = [beside(f // (n + 1), f % (n + 1)) for f in np.array_split(front, -(-len(front) // most))]
        front = np.concatenate([f[like[f] >= s.least - s.slack] for f in found])
    flat = np.concatenate([np.zeros(0, np.int64), *hits])
    return flat // (n + 1), flat % (n + 1)


def smallest_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the numbers below n the smallest that links lead to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


# --- the tasks ----------------------------------------------------------------------------------


def _graph(part: pd.DataFrame, s: Settings) -> pd.DataFrame:
    part = part.sort_values(["mix", "node"])
    nodes, x = part["node"].to_numpy(np.int64), unit_vectors(part["embedding"])
    a, b, medoid = build(x, s)
    near = np.split(nodes[b], np.searchsorted(a, np.arange(1, len(nodes))))
    return pd.DataFrame({
        "label": part["label"].iloc[0], "cluster": part["cluster"].iloc[0], "shard": part["shard"].iloc[0],
        "node": nodes, "near": near, "medoid": np.arange(len(nodes)) == medoid,
    })


def _neighbours(nodes: np.ndarray, lists: pd.Series) -> np.ndarray:
    """The places of those listed that are among ``nodes``, a row for each list, filled up with the number of nodes."""
    by = np.argsort(nodes, kind="stable")[::-1]  # of equal ids the last one counts
    names, first = np.unique(nodes[by], return_index=True)
    row = np.repeat(np.arange(len(nodes)), [len(x) for x in lists])
    listed = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
    spot = np.minimum(np.searchsorted(names, listed), len(names) - 1)
    row, spot = row[names[spot] == listed], by[first][spot[names[spot] == listed]]
    size = np.bincount(row, minlength=len(nodes))
    near = np.full((len(nodes), max(1, size.max())), len(nodes))
    near[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = spot
    return near


def _search(part: pd.DataFrame, asked: pd.DataFrame, s: Settings, at_once: int = 128) -> pd.DataFrame:
    """Per query the number of vectors found, per query and hit the smallest node linked with it here.

    ``part`` has the vectors, in rows with copies, and the lists of neighbours in others.
    """
    lists = part[part["copies"].isna()].drop_duplicates("node", keep="last").set_index("node")
    part = part[part["copies"].notna() & part["node"].isin(lists.index)]
    nodes = part["node"].to_numpy(np.int64)
    lists = lists.loc[nodes]
    if not len(nodes) or asked.empty:
        return pd.DataFrame({"node": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64"), "found": pd.Series(dtype="int64")})
    x, copies, near = unit_vectors(part["embedding"]), part["copies"].to_numpy(np.int64), _neighbours(nodes, lists["near"])
    starts = np.flatnonzero(lists["medoid"].to_numpy(bool)).tolist() or [0]
    queries, vectors = asked["query"].to_numpy(np.int64), unit_vectors(asked["vector"])
    found, pairs = [], []
    for at in range(0, len(queries), at_once):
        query = queries[at : at + at_once]
        q, k = in_range(vectors[at : at + at_once] @ x.T, near, starts, s)
        q, k = q[nodes[k] != query[q]], k[nodes[k] != query[q]]
        found.append(np.bincount(q, copies[k], minlength=len(query)).astype(np.int64))
        pairs.append(np.stack([query[q], nodes[k]]))
    a, b = np.concatenate(pairs, axis=1)
    everything, place = np.unique(np.concatenate([queries, a, b]), return_inverse=True)
    asked_at, a, b = np.split(place, [len(queries), len(queries) + len(a)])
    count = np.zeros(len(everything), np.int64)
    count[asked_at] = np.concatenate(found)
    return pd.DataFrame({"node": everything, "root": everything[smallest_linked(a, b, len(everything))], "found": count})


# --- the job ------------------------------------------------------------------------------------


def _classes(vectors: DataFrame) -> DataFrame:
    """One row for each label and different vector that can link: node (its smallest id), copies, unit."""
    x = F.col("embedding")
    rows = only(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), "embedding", "label")
    square = F.aggregate(x, F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite(x) & (square > 0))
    held = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    group = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    held = held.select("label", "embedding", group.alias("group"), "node", "copies")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(unit=[unit_vector(np.asarray(v, np.float64)) for v in batch["embedding"]])

    return held.mapInPandas(run, T.StructType([*held.schema.fields, T.StructField("unit", T.ArrayType(T.DoubleType()))]))


def unit_vector(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()  # so that no square is lost
    return x / np.sqrt(x @ x)


def unit_vectors(column: pd.Series) -> np.ndarray:
    """The same of many, which travel as they were given: those of floats take half the room."""
    x = np.concatenate([*column]).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _centres(classes: DataFrame, s: Settings) -> dict[str, np.ndarray]:
    """For each group (label and length) of many vectors a sample of them, in all ``max_centres`` at most."""
    total = classes.count()
    share = F.least(F.ceil(F.col("n") / s.cluster_rows), F.floor(F.col("n") * s.max_centres / F.lit(max(total, 1))))
    wanted = classes.groupBy("group").agg(F.count("*").alias("n")).select("group", share.alias("k")).filter("k > 1")
    order = Window.partitionBy("group").orderBy(F.xxhash64("node"), "node")
    rows = classes.select("group", "node", "unit").withColumn("place", F.row_number().over(order))
    rows = rows.filter(F.col("place") <= s.max_centres).join(wanted, "group").filter("place <= k")
    out: dict[str, list] = {}
    for r in rows.select("group", "place", "unit").collect():
        out.setdefault(r["group"], []).append((r["place"], r["unit"]))
    return {g: np.array([u for _, u in sorted(v)]) for g, v in out.items()}


def _assigned(classes: DataFrame, s: Settings) -> DataFrame:
    """A row for each vector and cluster that it joins; ``own`` marks its nearest cluster."""
    centres = _centres(classes, s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, part in batch.groupby("group"):
                if group not in centres:
                    yield part.assign(cluster=0, own=True)
                    continue
                near = unit_vectors(part["embedding"]) @ centres[group].T
                order = np.argsort(-near, axis=1, kind="stable")
                best = np.take_along_axis(near, order, 1)
                joins = best >= best[:, :1] - s.overlap
                joins[:, :2] = True
                row, place = np.nonzero(joins)
                out = part.iloc[row].reset_index(drop=True)
                yield out.assign(cluster=order[row, place], own=place == 0)

    rows = classes.select("group", "node", "copies", "embedding")
    more = [T.StructField("cluster", T.IntegerType()), T.StructField("own", T.BooleanType())]
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, *more]))


def _found(classes: DataFrame, s: Settings) -> DataFrame:
    """node, root, found: see ``_search``."""
    mix = F.xxhash64("node", F.lit(7))
    joined = stored(_assigned(classes, s).withColumn("mix", mix).withColumnRenamed("group", "label"), "assigned")
    shards = parts_needed(joined, "label", "cluster", most=s.shard_rows, name="shards")
    blocks = parts_needed(joined.filter("own"), "label", "cluster", most=s.shard_rows, name="blocks")
    sizes = stored(shards.join(blocks, ["label", "cluster"], "left").na.fill(0, ["blocks"]), "sizes")
    shard = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    placed = joined.join(sizes, ["label", "cluster"]).withColumn("shard", shard)

    def graph(part: pd.DataFrame) -> pd.DataFrame:
        return _graph(part, s)

    def search(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _search(part, asked, s)

    index = placed.select("label", "cluster", "shard", "node", "embedding", "mix")
    schema = "label string, cluster int, shard int, node long, near array<long>, medoid boolean"
    graphs = stored(index.groupBy("label", "cluster", "shard").applyInPandas(graph, schema), "graphs")
    united = graphs.groupBy("label", "node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    places = graphs.select("label", "cluster", "shard", "node", "medoid").join(sizes, ["label", "cluster"])
    # what stands in other shards of the cluster is no neighbour here, and most of a list
    here = F.filter("near", lambda n: F.pmod(F.xxhash64(n), F.col("shards")).cast("int") == F.col("shard")).alias("near")
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    cell = ["label", "cluster", "shard", "block"]
    lists = places.filter("blocks > 0").join(united.hint("merge"), ["label", "node"]).select(*cell[:3], each_block, "node", "medoid", here)
    vectors = placed.filter("blocks > 0").select(*cell[:3], each_block, "node", "copies", "embedding")
    regions = vectors.unionByName(lists, allowMissingColumns=True)
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("block")
    each_shard = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    query, vector = F.col("node").alias("query"), F.col("embedding").alias("vector")
    asked = placed.filter("own").select("label", "cluster", each_shard, block, query, vector).toDF(
        *[f"{c}_asked" for c in cell], "query", "vector"
    )
    return regions.groupBy(*cell).cogroup(asked.groupBy(*[f"{c}_asked" for c in cell])).applyInPandas(search, "node long, root long, found long")


def _audit(classes: DataFrame, counts: DataFrame, s: Settings) -> float:
    """The share of the links of a bounded, hashed sample that were found; all vectors are compared with it.

    It is taken in three ways, of which the least counts: over all links, as the mean over the vectors that have links,
    and as that mean with each vector weighted by one over the size of its group. So a large group, which has nearly all
    links and many vectors, does not hide that the links of small ones are missed.
    """
    sample = classes.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(s.audit_rows).select("group", "node", "unit").collect()
    groups: dict[str, tuple] = {}
    for group in sorted({r["group"] for r in sample}):
        mine = [r for r in sample if r["group"] == group]
        groups[group] = (np.array([r["node"] for r in mine]), np.array([r["unit"] for r in mine]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, part in batch.groupby("group"):
                if group in groups:
                    asked, units = groups[group]
                    nodes = part["node"].to_numpy(np.int64)
                    hit = (units @ matrix(part["unit"]).T >= s.least) & (asked[:, None] != nodes[None, :])
                    yield pd.DataFrame({"node": asked, "real": hit @ part["copies"].to_numpy(np.int64)})

    real = classes.select("group", "node", "copies", "unit").mapInPandas(run, "node long, real long")
    both = real.groupBy("node").agg(F.sum("real").alias("real")).join(counts, "node", "left").filter("real > 0")
    share = F.least(F.coalesce("found", F.lit(0)), "real") / F.col("real")
    ways = [F.sum(share * w) / F.sum(w) for w in (F.col("real"), F.lit(1), 1 / (F.col("real") + 1))]
    return min((x for x in both.agg(*ways).first() if x is not None), default=1.0)


def near_duplicates(vectors: DataFrame, settings: Settings | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall of every row of ``vectors`` (vec_id, embedding, label).

    Vectors of the same label and length link at a cosine of ``least`` or more, in double precision. Equal vectors are
    one node with a count, so copies are linked without being paired. Vectors that are null, zero or hold a null or
    non-finite component, and rows without a label, link with nothing; rows without an id do neither and have a null
    component and kept false. Rows with the same id are one node. If the audit finds too few links, the search is made
    wider, in the end as wide as a shard with every cluster overlapping; if that finds too few as well, a warning says
    so, and audit_recall is below what is wanted. An empty table gives an empty result.
    """
    s = settings or Settings()
    classes = stored(_classes(vectors), "classes")
    wider = replace(s, overlap=2 * s.overlap, search_width=4 * s.search_width, degree=2 * s.degree)
    widest = replace(wider, overlap=4.0, search_width=1 << 30)
    for tried in (s, wider, widest):
        found = stored(_found(classes.drop("label"), tried), "found")
        counts = stored(found.groupBy("node").agg(F.sum("found").alias("found")), "counts")
        recall = _audit(classes, counts, tried)
        if recall >= s.recall:
            break
    else:
        warnings.warn(f"the widest search has a recall of {recall:.3f}, {s.recall} is wanted", stacklevel=2)
    reached = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.select("label", "embedding", "node", "copies").join(counts, "node", "left").join(reached, "node", "left")
    ).select(
        "label", "embedding", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "node").alias("component"),
    )
    rows = only(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), "embedding", "label")
    linked = rows.filter("vec_id is not null and label is not null and embedding is not null")
    out = linked.join(of_class, ["label", "embedding"], "left").unionByName(
        rows.filter("vec_id is null or label is null or embedding is null"), allowMissingColumns=True
    )
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("audit_recall"),
    )
