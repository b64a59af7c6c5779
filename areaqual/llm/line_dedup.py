"""Line dedup by a suffix array over line-ID sequences.

Lines that occur once cannot be part of a repeated run; what is left are sequences of line ids. Their suffixes are
ranked by distributed prefix doubling: a rank for twice the length is the place of a pair of ranks in a global sort.
Suffixes with a common prefix of some length are one interval of that order; the least of its places is the first
copy, and at the others the run is deleted. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaqual.llm.common import WORD, only, stored

PLACE = ["doc_id", "h", "idx"]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), idx (number among the lines that are not blank), at (line number), line."""
    cut = F.transform(
        F.split("text", "\n"), lambda x, k: F.struct(k.alias("at"), F.regexp_replace(x, r"^[\s]+|[\s]+$", "").alias("line"))
    )
    full = F.filter(cut, lambda s: s["line"] != "")
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").filter("text is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(full).alias("idx", "s"))
    return rows.select("doc_id", "h", "idx", "s.at", "s.line")


def _in_order(distinct: DataFrame, *by: str) -> DataFrame:
    """A number for each row that rises with the order; the sort is distributed by ranges."""
    return distinct.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())


def _repeated(docs: DataFrame) -> DataFrame:
    """The lines that occur more than once: PLACE, at, words, rank_0."""
    key = F.unhex(F.md5(F.col("line").cast("binary")))
    words = F.regexp_count("line", F.lit(WORD)).cast("int")
    lines = stored(_lines(docs).select("doc_id", "h", "idx", "at", key.alias("key"), words.alias("words")), "lines")
    often = lines.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    ids = stored(_in_order(often, "key"), "line-ids")
    return lines.join(ids, "key").select(*PLACE, "at", "words", F.col("rank").alias("rank_0")).distinct()


def _with_window(words: Column, most: int) -> Column:
    """How many of the given numbers of words, from the first, make ``most``; null if all do not."""
    steps = F.aggregate(
        words,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
        lambda s, w: F.when(s["sum"] >= most, s).otherwise(
            F.struct((s["sum"] + w).alias("sum"), (s["n"] + 1).alias("n"))
        ),
    )
    return F.when(steps["sum"] >= most, steps["n"])


def repeated_runs(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """doc_id, h, first, last (line numbers), lines and words of every maximal run of lines that is a later copy.

    A run of lines with ``min_words`` words or more that stands elsewhere before, in the order of id, hash of the text
    and line, is a later copy; runs that overlap or touch are one. Lines are compared without white space at their
    ends, blank lines are passed over. What counts is the shortest run with enough words from each line on and up to
    each line: a longer run is the union of such runs. So ranks are needed only up to the longest of these. Each round
    doubles the length with one window over a document and one global sort of the different pairs; hot lines are one
    pair there, and joins back to them are split by adaptive execution. Nothing reaches the driver but a maximum.
    Repeated rows (of equal id and text) are one document. Null and empty texts have no lines, null ids come first.
    """
    found = stored(_repeated(docs), "repeated")
    by_doc = Window.partitionBy("doc_id", "h").orderBy("idx")
    found = found.withColumn("run", F.col("idx") - F.row_number().over(by_doc))
    in_run = Window.partitionBy("doc_id", "h", "run").orderBy("idx")
    ahead = F.collect_list("words").over(in_run.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("words").over(in_run.rowsBetween(1 - min_words, 0)))
    ranks = stored(
        found.withColumn("ahead", _with_window(ahead, min_words)).withColumn("behind", _with_window(behind, min_words)), "runs"
    )
    from_here = ranks.filter("ahead is not null").select("doc_id", "h", "idx", F.col("ahead").alias("n"))
    begin = (F.col("idx") - F.col("behind") + 1).alias("idx")
    up_to_here = ranks.filter("behind is not null").select("doc_id", "h", begin, F.col("behind").alias("n"))
    windows = stored(from_here.unionAll(up_to_here).distinct(), "windows")
    longest = windows.agg(F.max("n")).first()[0] or 0
    level, names = 0, ["rank_0"]
    while 2 << level <= longest:
        new = f"rank_{level + 1}"
        paired = stored(ranks.withColumn("next", F.lead(names[-1], 1 << level).over(in_run)), "paired")
        pairs = paired.filter("next is not null").groupBy(names[-1], "next").agg(F.count("*").alias("n")).filter("n > 1")
        order = _in_order(pairs.drop("n"), names[-1], "next").withColumnRenamed("rank", new)
        ranks = stored(paired.join(stored(order, "order").hint("merge"), [names[-1], "next"], "left").drop("next"), "ranks")
        names.append(new)
        level += 1
    return _later_copies(ranks, windows, names)


def _later_copies(ranks: DataFrame, windows: DataFrame, names: list[str]) -> DataFrame:
    """Windows (PLACE, n) whose lines stand elsewhere before, joined to runs of line numbers.

    The ranks of the longest power of two at the start and at the end of a window name its interval.
    """
    rank = F.element_at(F.array(*names), F.col("k") + 1)
    plain = ranks.select(*PLACE, *names)
    started = _joined(windows.withColumn("k", F.floor(F.log2(F.col("n"))).cast("int")), plain)
    started = started.select(*PLACE, "n", "k", rank.alias("r_a")).withColumn("begin", F.col("idx"))
    ended = _joined(started.withColumn("idx", F.expr("idx + n - shiftleft(1, k)")), plain)
    both = ended.select("doc_id", "h", F.col("begin").alias("idx"), "n", "r_a", rank.alias("r_b"))
    both = stored(both.filter("r_a is not null and r_b is not null"), "intervals")
    first = both.groupBy("n", "r_a", "r_b").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies"))
    later = both.join(first.filter("copies > 1"), ["n", "r_a", "r_b"]).filter(~F.struct(*PLACE).eqNullSafe(F.col("first")))
    later = stored(later, "later")  # alone in its stage, the join of a hot interval can be split
    lines = F.explode(F.sequence(F.col("idx"), (F.col("idx") + F.col("n") - 1).cast("int"))).alias("idx")
    covered = _joined(later.select("doc_id", "h", lines).distinct(), ranks.select(*PLACE, "at", "words"))
    by_doc = Window.partitionBy("doc_id", "h").orderBy("idx")
    runs = covered.withColumn("run", F.col("idx") - F.row_number().over(by_doc)).groupBy("doc_id", "h", "run")
    return runs.agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("lines"),
        F.sum("words").alias("words"),
    ).drop("run")


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on PLACE, null ids included. Both sides have a row for each line that repeats; as Spark sizes them by their
    files, in which ranks and numbers take a tenth of their room, it would gather them to broadcast them."""
    other = right.select(*[F.col(c).alias(f"{c}_r") if c in PLACE else F.col(c) for c in right.columns]).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_r")) & (F.col("h") == F.col("h_r")) & (F.col("idx") == F.col("idx_r"))
    return left.join(other, same).drop("doc_id_r", "h_r", "idx_r")


def delete_repeats(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """The rows of ``docs`` with the later copies of repeated runs (see ``repeated_runs``) deleted from the text.

    Every row stays, with an empty text if all of it repeats; blank lines within a deleted run go too. ``n_chars``, if
    there is such a column, is the new length. Texts without a deleted run are left as they are.
    """
    spans = repeated_runs(docs, min_words).groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last")).alias("__spans"))
    spans = spans.toDF("__id", "__h", "__spans")
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h"))
    joined = keyed.join(spans, same, "left")
    kept = F.filter(
        F.split("text", "\n"),
        lambda x, k: ~F.exists("__spans", lambda s: (s["first"] <= k) & (k <= s["last"])),
    )
    new = joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        size = F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        new = new.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])
