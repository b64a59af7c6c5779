"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same number of times, whole copies and a fraction. Two documents at a time
exchange words until the fraction of one is 0 or 1, by a random draw that keeps both expectations and the sum of words;
what is left of a bucket goes up a tree of buckets.

So that no long document is left for the end, those over a hundredth of their source's target are settled first, from the
longest down, each taking over the words that the one before was given too many or too few; the fractions of all others
take up the rest. Of these only documents of about one size (within a factor of two) are paired, so one of each size is
left, and they, with a few of each size that are kept back from pairing, are settled in the same way. So a source misses
its target by less than the shortest of them, unless it has too few documents to make up for a long one.
All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaqual.llm.common import only, repeated, stored, word_count

BUCKET = 32  # documents that a bucket holds on average, and buckets below a bucket
KEPT_BACK = 4  # documents of each size, on average, that are not paired
LONG, MOST_LONG = 0.01, 10_000  # settled first are documents over that share of the target, at most so many of a source
ITEM = "order double, u long, w double, f double, doc_id long, source string, h long, size long, base int, source_size long, target double"


def source_targets(units: DataFrame, most: float) -> DataFrame:
    """source, source_size, docs, target. ``units`` has source, size and n (equal rows).

    Weights 1, 2, 3, repeating, by code point, null last, share the sum of all sizes; a target over ``most`` times its
    source's size is cut to that and the excess shared by weight among the rest, until none is above.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row for each source
    weight = ((F.row_number().over(order) - 1) % 3 + 1).cast("double")
    sources = stored(sums.withColumn("weight", weight), "sources")
    most_words = F.col("source_size") * most
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:
        cut = F.lit(False) if level is None else F.col("weight") * level > most_words
        taken, left, n = sources.agg(
            F.sum(F.when(cut, most_words).otherwise(0.0)), F.sum(F.when(cut, 0.0).otherwise(F.col("weight"))),
            F.sum(F.when(cut, 1).otherwise(0)),
        ).first()
        new = (total - (taken or 0.0)) / left if left else level or 0.0
        if level is not None and n == before:
            break
        level, before = new, n
    return sources.select("source", "source_size", "docs", F.least(F.col("weight") * level, most_words).alias("target"))


def _draw(*of: Column) -> Column:
    """A number from 0 up to 1 that depends on nothing but the given columns."""
    return F.call_function("shiftrightunsigned", F.xxhash64(*of), F.lit(11)) * F.lit(2.0**-53)


def _round_bucket(items: Column) -> Column:
    """Fold a bucket in order: ``done`` has what became whole, ``rest`` the one that may be fractional."""

    def pair(state: Column, x: Column) -> Column:
        a, b = state["rest"], x
        up = F.least((1 - a["f"]) * a["w"], b["f"] * b["w"])  # words that may pass from b to a
        down = F.least(a["f"] * a["w"], (1 - b["f"]) * b["w"])
        rise = _draw(a["u"], b["u"]) * (up + down) < down
        a_first = F.when(rise, (1 - a["f"]) * a["w"] <= b["f"] * b["w"]).otherwise(a["f"] * a["w"] <= (1 - b["f"]) * b["w"])
        a_end, b_end = F.when(rise, 1.0).otherwise(0.0), F.when(rise, 0.0).otherwise(1.0)
        moved = F.when(rise, up).otherwise(-down)
        new_a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(a_first, a_end).otherwise(a["f"] + moved / a["w"])))
        new_b = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(a_first, b["f"] - moved / b["w"]).otherwise(b_end)))
        whole, rest = F.when(a_first, a.withField("f", new_a)).otherwise(b.withField("f", new_b)), F.when(
            a_first, b.withField("f", new_b)
        ).otherwise(a.withField("f", new_a))
        return F.struct(F.concat(state["done"], F.array(whole)).alias("done"), rest.alias("rest"))

    start = F.struct(F.slice(items, 1, 0).alias("done"), F.element_at(items, 1).alias("rest"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, pair)


def _settle(items: Column) -> Column:
    """Round documents, the longest first. ``carry`` are the words that the ones before owe: a document is taken by a draw
    with the chance that pays its own fraction and the debt, as far as it can. What is owed in the end is given beside."""

    def take(state: Column, x: Column) -> Column:
        due = x["f"] * x["w"] + state["carry"]
        taken = F.when(_draw(x["u"], F.lit(3)) * x["w"] < due, 1.0).otherwise(0.0)
        settled = F.concat(state["done"], F.array(x.withField("f", taken)))
        return F.struct(settled.alias("done"), (due - taken * x["w"]).alias("carry"))

    return F.aggregate(items, F.struct(F.slice(items, 1, 0).alias("done"), F.lit(0.0).alias("carry")), take)


def mix(docs: DataFrame, most: float = 3.0, seed: int = 1) -> DataFrame:
    """doc_id, source, h (hash of the text), size, source_size, target, copies and taken of every row of ``docs``.

    ``copies`` is how often the row enters the mix, ``most`` times at most; ``taken`` is copies times size. Size is the
    number of words, 0 for a null text; rows of size 0 are drawn one by one. Draws depend on ids, texts and ``seed``
    only, so reruns agree. Repeated rows are rounded one by one, null ids and sources like any other; an empty table
    gives no rows. No bucket depends on the size of a source; settled together are at most ``MOST_LONG`` documents of a source
    and about five for each doubling of size, and of the result nothing reaches the driver.
    """
    rows = only(docs, "doc_id", "source", "text").select(
        F.col("doc_id").cast("long"), "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size")
    )
    units = stored(rows.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("n")), "units")
    targets = source_targets(units, most).withColumnRenamed("source", "of")
    named = repeated(units, "n", "k").join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    share = F.least(F.lit(most), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    base = F.floor(share + 1e-12).cast("int")
    part = F.greatest(F.lit(0.0), share - base)
    u = F.xxhash64("doc_id", "source", "h", "size", "k", F.lit(seed))
    alike = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int")
    sizes = units.groupBy("source", alike.alias("alike")).agg(F.sum("n").alias("alike_docs"))
    sizes = stored(sizes.toDF("of", "alike", "alike_docs"), "sizes")  # some dozen rows for each source
    named = named.withColumn("__alike", alike)
    named = named.join(sizes, F.col("source").eqNullSafe(F.col("of")) & (F.col("__alike") == F.col("alike"))).drop("of", "__alike")
    items = named.select(
        F.pmod(u, F.ceil(F.col("alike_docs") / BUCKET)).alias("bucket"), "alike",
        (F.pmod(F.xxhash64(u, F.lit(4)), F.col("alike_docs")) < KEPT_BACK).alias("back"),
        (-F.col("size")).cast("double").alias("order"), u.alias("u"),
        F.col("size").cast("double").alias("w"), part.alias("f"), "doc_id", "source", "h", "size", base.alias("base"),
        "source_size", "target",
    )
    names = [c.split()[0] for c in ITEM.split(", ")]
    single = F.when(_draw(F.col("u"), F.lit(2)) < F.col("f"), 1.0).otherwise(0.0)
    done = items.filter("size = 0 or f = 0").withColumn("f", F.when(F.col("f") == 0, 0.0).otherwise(single)).select(*names)
    paired = stored(items.filter("size > 0 and f > 0"), "items")
    level, first = _long_first(paired, names)
    done = done.unionByName(first)
    level, back = level.filter("not back"), level.filter("back").select(*names)
    width = -(-(sizes.agg(F.max("alike_docs")).first()[0] or 0) // BUCKET)
    while True:
        grouped = level.groupBy("source", "alike", "bucket").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("items"))
        folded = stored(grouped.select("alike", "bucket", _round_bucket(F.col("items")).alias("s")), "folded")
        done = done.unionByName(folded.select(F.explode("s.done").alias("x")).select("x.*"))
        rest = folded.select("alike", F.floor(F.col("bucket") / BUCKET).alias("bucket"), "s.rest.*")
        if width <= 1:
            last = rest.select(*names).unionByName(back).groupBy("source").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("items"))
            done = done.unionByName(last.select(F.explode(_settle(F.col("items"))["done"]).alias("x")).select("x.*"))
            break
        level, width = rest, -(-width // BUCKET)
    copies = (F.col("base") + F.col("f").cast("int")).cast("int")
    return done.select(
        "doc_id", "source", "h", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def _long_first(items: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The shorter items, with the fractions that make up for the longer ones, and the longer ones, which are settled."""
    long = F.col("w") > F.greatest(F.col("target") * LONG, F.col("source_size") / MOST_LONG)
    listed = items.filter(long).groupBy("source").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("items"))
    settled = stored(listed.select("source", _settle(F.col("items")).alias("s")), "long")
    words = items.filter(~long).groupBy("source").agg(F.sum("w").alias("words"))
    debts = settled.select(F.col("source").alias("owing"), "s.carry").join(words, F.col("owing").eqNullSafe(F.col("source")))
    debts = stored(debts.select("owing", (F.col("carry") / F.col("words")).alias("shift")), "debts")  # a row for a source
    shorter = items.filter(~long).join(debts, F.col("source").eqNullSafe(F.col("owing")), "left").drop("owing")
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("f") + F.coalesce("shift", F.lit(0.0))))
    return shorter.withColumn("f", f).drop("shift"), settled.select(F.explode("s.done").alias("x")).select("x.*")


def mixed(docs: DataFrame, most: float = 3.0, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows that agree in id, source and text are repeats."""
    chosen = mix(docs, most, seed).groupBy("doc_id", "source", "h").agg(F.sum("copies").alias("__copies"))
    chosen = stored(chosen.filter("__copies > 0").toDF("__id", "__source", "__h", "__copies"), "chosen")
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__text") == F.col("__h"))
    )
    joined = keyed.join(chosen, same).dropDuplicates(["doc_id", "source", "__text"])
    return repeated(joined, "__copies", "__k", counts=chosen).select(*[F.col(f"`{c}`") for c in docs.columns])
