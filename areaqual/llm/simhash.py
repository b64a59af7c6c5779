"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

Two fingerprints that differ in at most 2s - 1 bits, cut into s segments, agree in one segment but for at most one
bit. So each fingerprint is indexed under every segment with every single bit of it wiped out; equal keys meet in a
join, and the distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaqual.llm.common import only, ship, stored
from areaqual.llm.components import connected_components

SEED = 42
BITS = 64
ship(__name__)


def fingerprint(text: bytes | None, shingle: int, at_once: int = 1 << 16) -> int:
    """The signed 64-bit fingerprint: a bit is set if it is in over half the hashes of the shingles.

    A-Z are lower-cased, words are cut at ASCII white space, repeats count; fewer words than a shingle make one
    shingle of all, none make 0.
    """
    words = text.lower().split() if text else ()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(line, SEED)).astype(np.int64))
    ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *[e + 1 for e in ends[: len(words) - shingle]]]
    digest, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(BITS, np.int64)
    for at in range(0, n, at_once):  # bounds what a very long text needs
        spans = zip(starts[at : at + at_once], ends[shingle - 1 + at : shingle - 1 + at + at_once])
        hashes = np.array([digest(line[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fingerprint (long) of every row; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(texts[k].as_py(), shingle) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, place: Column, width: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, (place * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """All pairs a < b of the given distinct fingerprints (column fp) that differ in 1 to ``max_bits`` bits, each once.

    A pair is taken only where it meets first: in its first segment that differs in at most one bit, under that bit,
    or under bit 0 if the segments are equal.
    """
    count = max_bits // 2 + 1
    while BITS % count:
        count += 1
    width = BITS // count
    if width == BITS:  # at most one bit: one segment
        raise ValueError("max_bits must be 2 at least")
    bit = F.col("bit")
    variants = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
    wiped = F.expr(f"shiftleft(1L, bit % {width})")
    rest = _segment(F.col("fp"), F.expr(f"bit div {width}"), width).bitwiseAND(F.bitwise_not(wiped))
    keyed = variants.select("fp", bit, rest.alias("rest"))
    a = keyed.select(F.col("fp").alias("a"), "bit", "rest")
    b = keyed.select(F.col("fp").alias("b"), "bit", "rest")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(None).cast("int")
    for k in reversed(range(count)):
        part = _segment(apart, F.lit(k), width)
        lone = F.when(part == 0, F.lit(0)).otherwise(F.bit_length(F.lit("")) + _low_bit(part))
        first = F.when(F.bit_count(part) <= 1, F.lit(k * width) + lone).otherwise(first)
    met = (F.col("a") < F.col("b")) & (F.bit_count(apart) <= max_bits) & (F.col("bit") == first)
    # Spark sizes the variants like the fingerprints, a 64th of what they are, and would gather them to broadcast them
    return a.join(b.hint("merge"), ["bit", "rest"]).filter(met).select("a", "b")


def _low_bit(one: Column) -> Column:
    """The place of the only bit of a number."""
    return F.bit_count(one - 1)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable by links) of every row.

    Equal fingerprints are linked without being paired: only distinct ones are indexed, so a group of copies of any
    size is one row there. A null or blank text has fingerprint zero and is linked like any other; rows with a null id
    keep it and take the component of their fingerprint, null if no row of it has an id. Repeated rows stay repeated.
    An empty table gives an empty result.
    """
    return _grouped(docs, shingle, max_bits).select("doc_id", "fingerprint", "component_id")


def _grouped(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """``near_duplicates`` with fp and component, which tells groups apart that have the same smallest id."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    pairs = links(classes.select("fp"), max_bits)
    reached = connected_components(pairs)
    linked = reached.join(classes.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = reached.join(least, "component").select(F.col("node").alias("fp"), "component", "component_id")
    whole = classes.join(moved, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id")
    )
    named = prints.join(whole, "fp")
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "fp", "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, unchanged, of the document that stands for its group: the one with the smallest id.

    Rows that repeat that id and fingerprint stay once; where rows of other fingerprints share the id, the one with the
    smallest fingerprint stays in each group that the id stands for, and none in other groups. Rows with a null id stay only in a group without any id, once for each
    fingerprint.
    """
    named = stored(_grouped(docs, shingle, max_bits), "grouped")
    chosen = named.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = chosen.filter("doc_id is not null").groupBy("doc_id", "component").agg(F.min("fp").alias("__fp"))
    shared = named.groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("shared"))
    first = first.join(shared, "doc_id").select(F.col("doc_id").alias("__id"), "__fp", "shared")
    same = F.col("doc_id").cast("long") == F.col("__id")
    alike = first.filter("not shared").select("__id")
    kept = docs.join(alike, same).drop("__id").dropDuplicates(["doc_id"])
    mixed = first.filter("shared").drop("shared")
    if not mixed.isEmpty():
        rows = docs.join(mixed.select("__id").distinct(), same).withColumn("__row", F.monotonically_increasing_id())
        rows = stored(rows, "shared")
        prints = fingerprints(rows.select(F.col("__row").alias("doc_id"), "text"), shingle).toDF("__row", "__fp")
        apart = rows.join(prints, "__row").join(mixed, ["__id", "__fp"]).dropDuplicates(["__id", "__fp"])
        kept = kept.unionByName(apart.select(*docs.columns))
    bare = docs.filter(F.col("doc_id").isNull())
    if bare.isEmpty():
        return kept
    alone = chosen.filter("doc_id is null").select("fingerprint").distinct()
    texts = bare.dropDuplicates(["text"]).withColumn("__key", F.coalesce("text", F.lit("")))
    return kept.unionByName(_first_of(texts, alone, shingle).drop("__key"))


def _first_of(texts: DataFrame, alone: DataFrame, shingle: int) -> DataFrame:
    """One row without an id for each fingerprint that only such rows have."""
    keyed = texts.select(F.monotonically_increasing_id().alias("doc_id"), F.col("__key").alias("text"))
    keyed = stored(keyed, "bare")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    prints = fingerprints(keyed, shingle).select("doc_id", hexed)
    first = prints.join(alone, "fingerprint").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    words = keyed.join(first, "doc_id").select(F.col("text").alias("__key"))
    return texts.join(words, "__key", "left_semi")
