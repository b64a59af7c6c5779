"""Document fingerprints by Order MinHash, which tell edits apart that plain MinHash does not see.

A text is a sequence of k-mers (k code points each), and a k-mer that comes again is numbered, so no two are alike. For
each of ``count`` orders the ``chosen`` least of them are taken and put back into the order of the text; a hash of the
k-mers in this order is one part of the fingerprint. Parts agree if both texts have the same least k-mers *and* have
them in the same order, which becomes rarer with every insertion, deletion and move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaqual.llm.common import col, ship, stored

PART = 16  # bits of a part
ship(__name__)


@dataclass(frozen=True)
class Sketch:
    """Length of the k-mers in code points, how many are chosen for a part, how many parts, and the seed of the orders."""

    k: int = 6
    chosen: int = 2
    count: int = 64
    seed: int = 42

    def orders(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each part: x -> (x ^ first) * second, the second one odd, puts mixed 32-bit hashes in an order."""
        drawn = mixed(np.arange(1, 2 * self.count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))
        drawn = (drawn >> np.uint64(32)).astype(np.uint32)
        return drawn[: self.count], drawn[self.count :] | np.uint32(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with all bits spread over all others, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A hash for the k-mer at every place; fewer than ``k`` code points are one k-mer, none give none."""
    k = min(k, len(points))
    if not k:
        return np.empty(0, np.uint64)
    n = len(points) - k + 1
    held = np.full(n, k, np.uint64)
    for j in range(k):
        held = held * np.uint64(0x100000001B3) + points[j : j + n]
    return mixed(held)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often the same hash stands before each place."""
    n, bits = len(hashes), np.uint64(16)
    if n <= 1 << 16:  # hash and place in one number are sorted faster; 48 bits tell so few apart
        ranked = np.sort(hashes >> bits << bits | np.arange(n, dtype=np.uint64))
        order, ranked = (ranked & np.uint64((1 << 16) - 1)).astype(np.int64), ranked >> bits
    else:
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
    out = np.zeros(n, np.uint64)
    again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    if len(again):
        new = np.ones(n, bool)
        new[again] = False
        places = np.arange(n)
        out[order] = places - np.maximum.accumulate(np.where(new, places, 0))
    return out


def order_minhash(points: np.ndarray, sketch: Sketch, at_once: int = 1 << 16, orders: tuple | None = None) -> np.ndarray:
    """The parts of the fingerprint of some code points; without any, all parts are alike. ``orders`` of the sketch may be
    given, to make them once. Between k-mers that an order makes equal, the first one in the text counts as less."""
    hashes = kmer_hashes(points, sketch.k)
    n, chosen = len(hashes), min(sketch.chosen, len(hashes))
    if not n:
        return np.zeros(sketch.count, np.uint16)
    numbered = mixed(hashes + occurrences(hashes) * np.uint64(0x9E3779B97F4A7C15))
    numbered = (numbered >> np.uint64(32)).astype(np.uint32)
    first, second = orders or sketch.orders()
    rows, found = max(1, at_once // n), []
    for at in range(0, sketch.count, rows):  # bounds what a very long text needs
        order = (numbered ^ first[at : at + rows, None]) * second[at : at + rows, None]
        line, least = np.arange(len(order)), []
        for _ in range(chosen):
            least.append(order.argmin(axis=1))
            order[line, least[-1]] = np.iinfo(np.uint32).max
        found.append(np.sort(np.stack(least, axis=1), axis=1))
    in_text = hashes[np.concatenate(found)]
    parts = np.zeros(sketch.count, np.uint64)
    for j in range(chosen):
        parts = mixed(parts * np.uint64(0x100000001B3) + in_text[:, j])
    return (parts >> np.uint64(64 - PART)).astype(np.uint16)


def spelled(parts: np.ndarray) -> bytes:
    return parts.astype(f">u{PART // 8}").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the parts that agree, 0 to 1."""
    return float((a == b).mean())


def likeness_of(a: Column, b: Column, sketch: Sketch) -> Column:
    """Share of the parts of two fingerprints, as hex digits, that agree; null if either is null."""
    width = PART // 4
    same = F.transform(
        F.sequence(F.lit(0), F.lit(sketch.count - 1)),
        lambda i: (F.substr(a, i * width + 1, F.lit(width)) == F.substr(b, i * width + 1, F.lit(width))).cast("int"),
    )
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(sketch.count))


def fingerprints(docs: DataFrame, sketch: Sketch = Sketch(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in ``keep``, n_chars (code points) and fingerprint (hex digits) of every whole text.

    A null text counts as an empty one; all empty texts have the fingerprint of zeros. Texts shorter than a k-mer are one
    k-mer, and with fewer k-mers than are chosen all are taken. Equal texts have equal fingerprints, repeated rows stay
    repeated, an empty table gives an empty result, and further columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = sketch.orders()
        for batch in batches:
            sizes, prints = [], []
            for at in range(batch.num_rows):
                points = code_points(batch.column(0)[at].as_py() or "")
                sizes.append(len(points))
                prints.append(spelled(order_minhash(points, sketch, orders=orders)).hex())
            rest = [batch.column(k + 1) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64()), pa.array(prints, pa.string())], names=[*keep, "n_chars", "fingerprint"])

    rows = docs.select(col(docs, text), *[col(docs, c) for c in keep])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kept}, n_chars long, fingerprint string")


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The second half (rounded down) gives way to as many code points from the beginning of the next text, or all."""
    half = len(points) // 2
    return np.concatenate([points[: len(points) - half], following[:half]])


class _Row:
    """A text on its way through ``edit_likeness``."""

    def __init__(self, doc_id: int | None, text: str | None, sketch: Sketch, orders: tuple) -> None:
        self.doc_id, self.text, self.sketch, self.orders = doc_id, text or "", sketch, orders
        self.points = code_points(self.text)
        self.parts = order_minhash(self.points, sketch, orders=orders)

    def beside(self, following: _Row) -> dict:
        changed = edited(self.points, following.points)
        parts = order_minhash(changed, self.sketch, orders=self.orders)
        digest = hashlib.sha256(changed.tobytes().decode("utf-32-le").encode()).digest()
        return {
            "doc_id": self.doc_id, "n_chars": len(self.points), "sha256": digest, "print": spelled(self.parts),
            "edited_print": spelled(parts), "near_edited": likeness(self.parts, parts), "near_next": likeness(self.parts, following.parts),
        }


_FOUND = "doc_id long, n_chars long, sha256 binary, print binary, edited_print binary, near_edited double, near_next double"
_FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha256", pa.binary()), ("print", pa.binary()),
    ("edited_print", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_INNER, _FIRST, _LAST = 0, 1, 2


def edit_likeness(docs: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """How like each text is to an edited copy of it and to the next text, by descending doc_id (after the last: the first).

    doc_id, n_chars, edited_sha256 (of the edited text in UTF-8; see ``edited``), fingerprint, edited_fingerprint (hex
    digits), near_edited, near_next (0 to 1). Rows without an id come last; rows of one id follow each other by a hash of
    their text, so repeated rows are next to each other. A null text is an empty one. A lone row is its own next one,
    and an empty table gives an empty result.

    Texts are sorted in one range shuffle, in which rows of one id spread too, and read as they come. The last row of each
    partition waits for the first one of the next: both are stored, a pair for each partition, and meet in a small join.
    """
    rows = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), col(docs, "text").alias("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.col("hash").asc(), F.col("part").asc()]
    spread = rows.select("*", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("part"))
    ordered = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    schema = pa.schema([("role", pa.int32()), ("part", pa.int32()), ("text", pa.string()), *_FIELDS])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, orders = TaskContext.get().partitionId(), None, sketch.orders()

        def mark(role: int, row: _Row) -> dict:
            return {"role": role, "part": part, "text": row.text, "doc_id": row.doc_id}

        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                row = _Row(batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), sketch, orders)
                found.append({"role": _INNER} | before.beside(row) if before else mark(_FIRST, row))
                before = row
            yield pa.RecordBatch.from_pylist(found, schema)
        if before:
            yield pa.RecordBatch.from_pylist([mark(_LAST, before)], schema)

    walked = stored(ordered.mapInArrow(walk, f"role int, part int, text string, {_FOUND}"), "edit-likeness")
    parts = sorted(r["part"] for r in walked.filter(F.col("role") == _FIRST).select("part").collect())
    pairs = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, following int")
    first = walked.filter(F.col("role") == _FIRST).select(F.col("part").alias("following"), F.col("text").alias("next_text"))
    ends = walked.filter(F.col("role") == _LAST).select("part", "doc_id", "text").join(pairs, "part").join(first, "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = sketch.orders()
        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, text, following = (batch.column(k)[at].as_py() for k in range(3))
                after = _Row(None, following, sketch, orders)
                yield pa.RecordBatch.from_pylist([_Row(doc_id, text, sketch, orders).beside(after)], _FIELDS)

    closed = ends.select("doc_id", "text", "next_text").mapInArrow(close, _FOUND)
    whole = walked.filter(F.col("role") == _INNER).drop("role", "part", "text").unionByName(closed)

    def digits(name: str) -> Column:
        return F.lower(F.hex(name))

    return whole.select(
        "doc_id", "n_chars", digits("sha256").alias("edited_sha256"), digits("print").alias("fingerprint"),
        digits("edited_print").alias("edited_fingerprint"), "near_edited", "near_next",
    )
