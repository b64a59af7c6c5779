"""Ranked lexical search over an index by length.

A document's length enters its scores only through a whole number m. Documents of equal m form a stratum (a large one
is dealt to blocks), and a stratum lists per term the documents by how often they hold it. All documents of a list
therefore give the same share to a score, which is computed once for the list. The longest tf of each term bounds what
a stratum can reach: for every query the strata are visited from the highest bound down, until the k-th score found is
above all that are left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areaqual.llm.common import only, ship, stored

#: A term is a run of ASCII letters, digits and anything beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: By byte of UTF-8: the letter as it counts, or a space.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
ship(__name__)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8; null has none."""
    return text.encode().translate(FOLD).split() if text else []


@dataclass
class Index:
    """``strata``: block, doc_id (array), m (array, ascending) of blocks of strata. ``postings``: block, term, df (documents
    of the block that hold it), places (of these in the block's arrays) and tfs. ``n_docs`` and ``n_terms``: documents
    with a term, and all their terms."""

    strata: DataFrame
    postings: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, block_terms: int = 1 << 20, deal_terms: int = 1 << 16) -> Index:
    """The index of the whole texts of ``docs``, stored.

    Documents without a term (null or empty texts too) are in no list. A block holds about ``block_terms`` terms, or one
    document that is longer. Strata are dealt to tasks in parts of about ``deal_terms``, by a hash of the document, and a
    task gathers the parts it gets in blocks, so small strata share one. Repeated rows are documents of their own, with the
    same id; a null id is kept.
    """
    rows = only(docs, "doc_id", "text").select("text", F.col("doc_id").cast("long").alias("doc_id"))
    counted = rows.select("text").mapInArrow(_lengths, "n long, docs long")
    lengths = stored(counted.groupBy("n").agg(F.sum("docs").alias("docs")), "lengths")
    total = lengths.agg(F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("docs")).alias("terms")).first()
    n_docs, n_terms = int(total["docs"] or 0), int(total["terms"] or 0)
    found = rows.mapInArrow(_tokens(n_docs, n_terms), "doc_id long, m long, n long, terms binary, tfs binary")
    m = F.lit(25) + F.expr(f"cast(cast(n as decimal(20, 0)) * {75 * n_docs}BD div {max(n_terms, 1)}BD as long)")
    parts = F.ceil(F.sum(F.col("n") * F.col("docs")) / deal_terms).alias("parts")
    by_m = stored(lengths.groupBy(m.alias("m")).agg(parts), "strata-sizes")
    deal = F.pmod(F.xxhash64("doc_id", "terms", "tfs", F.spark_partition_id()), F.col("parts"))
    dealt = found.join(by_m, "m").withColumn("deal", deal).select("doc_id", "m", "n", "terms", "tfs", "deal")
    ordered = dealt.repartition("m", "deal").sortWithinPartitions("m", "deal").drop("deal")
    made = stored(ordered.mapInArrow(_indexer(block_terms), _MADE), "lexical-index")
    strata = made.filter("term is null").select("block", "doc_id", "m")
    postings = made.filter("term is not null").select("block", "term", "df", "places", "tfs")
    return Index(strata, postings, n_docs, n_terms)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents have how many terms, of those that have any."""
    held: Counter[int] = Counter()
    for batch in batches:
        held.update(len(terms_of(batch.column(0)[at].as_py())) for at in range(batch.num_rows))
    held.pop(0, None)
    columns = [pa.array(list(x), pa.int64()) for x in (held.keys(), held.values())]
    yield pa.RecordBatch.from_arrays(columns, names=["n", "docs"])


def _tokens(n_docs: int, n_terms: int):
    """Of documents with a term: m (25, and 75 times the length beside the mean one, rounded down), the number of terms,
    the different terms, joined by spaces, and their tfs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                terms = terms_of(batch.column(0)[at].as_py())
                if terms:
                    held = Counter(terms)
                    tfs = np.fromiter(held.values(), np.int32, len(held)).tobytes()
                    rows.append((batch.column(1)[at].as_py(), 25 + 75 * len(terms) * n_docs // n_terms, len(terms), b" ".join(held), tfs))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "m", "n", "terms", "tfs"])

    return run


_MADE = "block long, term string, df int, doc_id array<long>, m array<long>, places array<int>, tfs array<int>"


def _indexer(block_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 33, _Block()
        for batch in batches:
            for at in range(batch.num_rows):
                held.add(*(batch.column(c)[at].as_py() for c in ("doc_id", "m", "n", "terms", "tfs")))
                if held.size >= block_terms:
                    yield held.rows(block)
                    block, held = block + 1, _Block()
        if held.size:
            yield held.rows(block)

    return run


class _Block:
    """Documents in ascending m, and the lists of their terms."""

    def __init__(self) -> None:
        self.ids, self.m, self.size = [], [], 0
        self.names: dict[bytes, int] = {}
        self.found, self.tfs = [], []

    def add(self, doc_id: int | None, m: int, n: int, terms: bytes, tfs: bytes) -> None:
        names, held = self.names, terms.split(b" ")
        self.found.append(np.fromiter((names.setdefault(t, len(names)) for t in held), np.int64, len(held)))
        self.tfs.append(np.frombuffer(tfs, np.int32))
        self.ids.append(doc_id)
        self.m.append(m)
        self.size += n

    def rows(self, block: int) -> pa.RecordBatch:
        """A row for the documents, without a term, then one for each term."""
        term, tf = np.concatenate(self.found), np.concatenate(self.tfs)
        place = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(f) for f in self.found])
        order = np.argsort(term, kind="stable")  # places stay in ascending order, so m does too
        upto = np.concatenate([[0, 0], np.cumsum(np.bincount(term, minlength=len(self.names)))]).astype(np.int32)
        n = 1 + len(self.names)
        none = np.concatenate([[0], np.full(n, len(self.ids))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, block)), pa.array([None, *[t.decode() for t in self.names]], pa.string()),
            pa.array(np.diff(upto)), pa.ListArray.from_arrays(pa.array(none), pa.array(self.ids, pa.int64())),
            pa.ListArray.from_arrays(pa.array(none), pa.array(self.m, pa.int64())),
            pa.ListArray.from_arrays(pa.array(upto), pa.array(place[order])),
            pa.ListArray.from_arrays(pa.array(upto), pa.array(tf[order])),
        ], names=["block", "term", "df", "doc_id", "m", "places", "tfs"])


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term and qtf of every query with a term."""
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = only(queries, "item_id", "text").select("item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM), 0)).alias("term"))
    return listed.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def weighted(terms: DataFrame, index: Index) -> DataFrame:
    """``query_terms`` that the index holds, with their weight: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    wanted = terms.select("term").distinct()
    df = index.postings.select("term", "df").join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(2.0 * index.n_docs + 2.0) / (2.0 * F.col("df") + 1.0)
    return terms.join(df.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w")), "term")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term gives to a score before its weight, in whole numbers."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Shard:
    """A block of the index in memory, for the terms that are asked for."""

    def __init__(self, ids: list, m: np.ndarray, terms: list[str], upto: np.ndarray, places: np.ndarray, tfs: np.ndarray):
        """``places`` and ``tfs`` of all terms one after the other, ``upto`` where each term's begin and the last ones end.

        An impact is computed once for each stratum and tf. Per list: its places, their impacts, the strata that hold the
        term, where the places of each begin, and the highest impact in each.
        """
        self.ids, self.starts = ids, np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        self.m = m[self.starts]
        self.ends = np.concatenate([self.starts[1:], [len(ids)]])
        stratum = np.repeat(np.arange(len(self.m)), self.ends - self.starts)[places]
        wide = int(tfs.max(initial=0)) + 1
        pairs, which = np.unique(stratum * wide + tfs, return_inverse=True)
        values = impact(pairs % wide, self.m[pairs // wide])[which]
        new = np.concatenate([[True], stratum[1:] != stratum[:-1]])[: len(stratum)]
        new[upto[:-1]] = True
        runs = np.flatnonzero(new)
        highest, of_run = np.maximum.reduceat(values, runs), stratum[runs]
        at = np.searchsorted(runs, upto)
        self.lists = {
            t: (places[s:e], values[s:e], of_run[i:j], np.append(runs[i:j], e) - s, highest[i:j])
            for t, s, e, i, j in zip(terms, upto[:-1].tolist(), upto[1:].tolist(), at[:-1].tolist(), at[1:].tolist())
        }

    def better(self, query: list[tuple[str, int]], k: int, found: list) -> list:
        """The ``k`` best of those found before, as (-score, id is null, id), and of the documents here, in order."""
        held = [(*self.lists[t], w) for t, w in query if t in self.lists and w > 0]
        bounds = np.zeros(len(self.m), np.int64)
        for _, _, strata, _, highest, w in held:
            bounds[strata] += w * highest
        order = np.argsort(-bounds, kind="stable")
        bounds, visited, step = bounds[order], 0, 1
        while True:
            least = -found[-1][0] if len(found) == k else 1  # equal scores may have the smaller id
            last = min(visited + step, int(np.searchsorted(-bounds, -least, "right")))
            if last <= visited:
                return found
            found = self._visit(np.sort(order[visited:last]), held, found, k, least)
            visited, step = last, step * 2  # ever more at a time: each visit has a fixed cost

    def _visit(self, at: np.ndarray, held: list, found: list, k: int, least: int) -> list:
        """The best of those found and of the documents of some strata with a score of ``least`` or more."""
        sizes = (self.ends - self.starts)[at]
        begins = np.cumsum(sizes) - sizes
        shift = np.zeros(len(self.m), np.int64)
        shift[at] = begins - self.starts[at]  # from a place in the block to one among these documents
        wanted = np.zeros(len(self.m), bool)
        wanted[at] = True
        scores = np.zeros(int(sizes.sum()), np.int64)
        for places, values, strata, begin, _, w in held:
            runs = np.flatnonzero(wanted[strata])
            lengths = begin[runs + 1] - begin[runs]
            inside = np.repeat(begin[runs] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            scores[places[inside] + np.repeat(shift[strata[runs]], lengths)] += w * values[inside]
        if len(scores) > k:
            least = max(least, int(np.partition(scores, -k)[-k]))
        good = np.flatnonzero(scores >= least)
        rows = good - shift[at][np.searchsorted(begins, good, "right") - 1]
        ids = [self.ids[r] for r in rows.tolist()]
        return sorted([*found, *((-s, i is None, i or 0) for s, i in zip(scores[good].tolist(), ids))])[:k]


def search(index: Index, queries: DataFrame, k: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents with a score above 0 of every query.

    Equal scores are ranked by ascending doc_id, null ids last. Queries without a known term have no rows; repeated
    rows of ``queries`` with one item_id count as one query that has all their terms, repeats included. An empty index
    or no queries give an empty result.

    Queries are worked through in parts of at most about ``block_bytes``, the only thing that is sent to every task; each
    meets the lists of its own terms alone, gathered by block of the index.
    """
    asked = stored(weighted(query_terms(queries), index), "query-terms")
    size = asked.agg(F.sum(F.length("term") + 32)).first()[0] or 0
    parts = int(size // block_bytes) + 1
    found = None
    for part in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        some = _search_part(index, mine, k)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_part(index: Index, asked: DataFrame, k: int) -> DataFrame:
    items: dict[int | None, list[tuple[str, int]]] = {}
    for r in asked.collect():  # bounded by the caller
        items.setdefault(r["item_id"], []).append((r["term"], r["qtf"] * r["w"]))
    held = asked.sparkSession.sparkContext.broadcast(items)
    lists = index.postings.join(asked.select("term").distinct(), "term")
    gathered = lists.groupBy("block").agg(F.collect_list(F.struct("term", "places", "tfs")).alias("lists"))
    blocks = index.strata.join(gathered, "block").select("doc_id", "m", "lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, list] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                ids, m = batch.column(0)[at].as_py(), np.array(batch.column(1)[at].values)
                lists = batch.column(2).slice(at, 1).flatten()
                places, tfs = (lists.field(n) for n in ("places", "tfs"))
                upto = np.array(places.offsets) - places.offsets[0].as_py()
                flat = [x.flatten().to_numpy().astype(np.int64) for x in (places, tfs)]
                shard = Shard(ids, m, lists.field("term").to_pylist(), upto, *flat)
                for item, query in held.value.items():  # what the blocks before gave bounds this one's visits
                    best[item] = shard.better(query, k, best.get(item, []))
        rows = [(item, None if none else i, -s) for item, found in best.items() for s, none, i in found]
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return blocks.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``search`` in a new index of ``docs``."""
    return search(build_index(docs), queries, k)
