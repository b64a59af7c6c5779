"""Shards of bounded size by extendible hashing.

A directory is indexed by the leading bits of a hash; a bucket over the byte limit is split on its next bit, and no
other bucket is. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areaqual.llm.common import col, free_name, repeated, stored

HASH_BITS = 60


def hashed(docs: DataFrame) -> DataFrame:
    """The rows with ``__hash`` (60 bits of the MD5 of id and text) and ``__bytes`` (of the text, null 0)."""
    of = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    number = F.conv(F.substring(F.md5(of.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.withColumn("__hash", number).withColumn("__bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))


def _prefix(depth) -> F.Column:
    return F.call_function("shiftright", F.col("hash"), (F.lit(HASH_BITS) - depth).cast("int"))


def directory(rows: DataFrame, max_bytes: int, bits_at_once: int = 12) -> DataFrame:
    """The buckets: depth, prefix, shard_bytes, shard_docs. ``rows`` has hash, bytes (of one) and n (equal rows).

    Sums are taken for ``bits_at_once`` bits at a time, from them for every shorter prefix; only the rows of buckets
    that are still too large are looked at again with more bits. A bucket ends at the shortest prefix that fits.
    """
    done, base, left = None, 0, rows
    while True:
        top = min(base + bits_at_once, HASH_BITS)
        fine = left.groupBy(_prefix(F.lit(top)).alias("fine")).agg(
            F.sum(F.col("bytes") * F.col("n")).alias("b"), F.sum("n").alias("d")
        )
        depths = F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")
        cut = F.call_function("shiftright", F.col("fine"), (F.lit(top) - F.col("depth")).cast("int"))
        sums = fine.select(depths, "fine", "b", "d").withColumn("prefix", cut).groupBy("depth", "prefix").agg(
            F.sum("b").alias("shard_bytes"), F.sum("d").alias("shard_docs")
        )
        fits = (F.col("shard_bytes") <= max_bytes) | (F.col("depth") == HASH_BITS)
        sums = stored(sums.withColumn("fits", fits), "sums")
        parent = F.call_function("shiftright", F.col("prefix"), F.lit(1))
        split = sums.filter(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        kept = sums.filter("fits").withColumn("parent", parent)
        begin = kept.filter(F.col("depth") == base)
        if base:
            begin = begin.limit(0)  # what fits there was a bucket before
        found = begin.drop("parent").unionByName(kept.join(split, ["depth", "parent"]).drop("parent")).drop("fits")
        done = found if done is None else done.unionByName(found)
        large = sums.filter((F.col("depth") == top) & ~F.col("fits")).select(F.col("prefix").alias("large"))
        if top == HASH_BITS or large.isEmpty():
            return done
        left, base = left.join(large, _prefix(F.lit(top)) == F.col("large"), "left_semi"), top


def _placed(docs: DataFrame, max_bytes: int) -> DataFrame:
    """Per distinct row: doc_id, hash, bytes, n, depth, prefix, shard_bytes, shard_docs, over and rows in a part if so."""
    rows = hashed(docs).select(F.col("doc_id").cast("long"), F.col("__hash").alias("hash"), F.col("__bytes").alias("bytes"))
    rows = stored(rows.groupBy("doc_id", "hash", "bytes").agg(F.count("*").alias("n")), "rows")
    shards = directory(rows.select("hash", "bytes", "n"), max_bytes)
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())  # at most one for each bit of the hash
    each = F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth") if depths else F.lit(0).alias("depth")
    keyed = rows.select("*", each).withColumn("prefix", _prefix(F.col("depth")))
    one = keyed.join(shards, ["depth", "prefix"])
    over = (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > max_bytes)
    per_part = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.col("bytes"))).cast("long")
    return one.withColumn("over", over).withColumn("per_part", F.when(F.col("over"), per_part))


def assign_shards(docs: DataFrame, max_bytes: int) -> DataFrame:
    """Per row of ``docs``: doc_id, depth, prefix, part, bytes and, of its shard, shard_bytes and shard_docs.

    The shard is named by depth, prefix (the leading ``depth`` bits of the hash) and part. ``part`` is 0 but where rows
    with one hash are over the limit together: these are repeated rows, dealt to parts that hold as many as fit, at
    least one. So no shard is over the limit except one of a single text that is. A null text has no bytes, a null id
    is hashed like an empty one; other columns do not matter, and an empty table gives no shards.
    """
    over, per_part = F.col("over"), F.col("per_part")
    numbered = repeated(stored(_placed(docs, max_bytes), "placed"), "n", "k")
    part = F.when(over, F.floor((F.col("k") - 1) / per_part)).otherwise(0).cast("long")
    docs_there = F.when(over, F.least(per_part, F.col("n") - part * per_part)).otherwise(F.col("shard_docs"))
    bytes_there = F.when(over, docs_there * F.col("bytes")).otherwise(F.col("shard_bytes"))
    return numbered.select(
        "doc_id", "depth", "prefix", part.alias("part"), "bytes", bytes_there.alias("shard_bytes"),
        docs_there.cast("long").alias("shard_docs"),
    )


def write_shards(docs: DataFrame, path: str, max_bytes: int) -> None:
    """Write all rows of ``docs`` below ``path``, one folder for each shard; repeated rows are written as often as given.

    The folders are shard=<depth>-<prefix>/part=<part>, with the parts of ``assign_shards``: repeated rows that are over
    the limit together are numbered in chunks of the input and dealt to parts, each of which is one file. If ``docs`` has
    a column of one of these names, the folders' name gets an underscore behind it.
    """
    shard, part = (free_name(n, docs.columns) for n in ("shard", "part"))
    placed = _placed(docs, max_bytes).select("doc_id", "hash", "bytes", "depth", "prefix", "per_part")
    one = stored(placed.toDF("__p_id", "__p_hash", "__p_bytes", "__depth", "__prefix", "__per_part"), "placed")
    keyed = hashed(docs).withColumn("__id", F.col("doc_id").cast("long"))
    same = (
        F.col("__id").eqNullSafe(F.col("__p_id")) & (F.col("__hash") == F.col("__p_hash")) & (F.col("__bytes") == F.col("__p_bytes"))
    )
    name = F.concat(F.col("__depth").cast("string"), F.lit("-"), F.hex("__prefix"))
    own = [col(docs, c) for c in docs.columns]
    joined = keyed.join(one, same).select(*own, name.alias(shard), "__per_part", "__hash", "__bytes")
    out = joined.filter("__per_part is null").select(*own, shard, F.lit(0).cast("long").alias(part))
    if not one.filter("__per_part is not null").isEmpty():
        out = out.unionByName(_dealt(joined.filter("__per_part is not null"), part).select(*own, shard, part))
    out.repartition(shard, part).write.partitionBy(shard, part).parquet(path)


def _dealt(rows: DataFrame, name: str, chunk_bits: int = 13) -> DataFrame:
    """The rows with their part as ``name``: equal ones are numbered within chunks, and the counts of the chunks before are added."""
    # Stored, as numbers that follow the input's partitions must not change between counting and use.
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "repeated")
    rows = rows.withColumn("__chunk", F.call_function("shiftright", F.col("__row"), F.lit(chunk_bits)))
    key = ["__hash", "__bytes", "__chunk"]
    earlier = Window.partitionBy("__hash", "__bytes").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    before = counts.select(*key, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    numbered = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy("__row")))
    part = F.floor((F.col("__before") + F.col("__k") - 1) / F.col("__per_part")).cast("long")
    return numbered.join(before, key).withColumn(name, part)
