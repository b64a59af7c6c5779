"""Targets of the mix, repeated rows, and tables whose columns have the names of folders."""

import random

import pytest
from pyspark.sql import functions as F

from areaqual.llm import common, mixing, sharding


def documents(spark, sizes):
    """Sizes by source, as documents of so many words."""
    rows = [(k, f"{' '.join(['w'] * n)} {k}", s) for k, (s, n) in enumerate((s, n - 1) for s, of in sizes.items() for n in of)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_a_source_with_one_very_long_text_meets_its_target(spark):
    rng = random.Random(3)
    sizes = {s: [rng.randrange(2, 400) for _ in range(300)] for s in "abcdef"}
    for s in "adf":
        sizes[s] = [20_000] + [rng.randrange(2, 1500) for _ in range(120)]
    for seed in range(1):
        got = mixing.mix(documents(spark, sizes), seed=seed).groupBy("source").agg(
            F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")
        ).collect()
        assert len(got) == 6 and all(r["over"] <= 0 for r in got)
        assert all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in got), got


def test_a_long_document_is_taken_once_or_not_as_its_share_says(spark):
    sizes = {"a": [900] + [30] * 60, "b": [30] * 60}
    taken = [mixing.mix(documents(spark, sizes), seed=k).where("size = 900").first() for k in range(5)]
    share = taken[0]["target"] / taken[0]["source_size"]
    assert {r["copies"] for r in taken} <= {int(share), int(share) + 1}


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_rows_are_repeated_and_numbered_in_stretches(spark, step):
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 30), ("d", 0)], "k string, n long")
    got = common.repeated(df, "n", "i", step).select("k", "i").collect()
    want = [(k, i) for k, n in (("a", 1), ("b", 7), ("c", 30)) for i in range(1, n + 1)]
    assert sorted(map(tuple, got)) == want


def test_many_equal_rows_are_mixed_and_dealt(spark):
    one = spark.range(40_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same words").alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(one.unionByName(documents(spark, {"t": [10] * 50})))
    assert mixed.count() == 40_050 and mixed.groupBy("source").agg(F.max("copies")).count() == 2
    shards = sharding.assign_shards(one, 14 * 1000)
    assert shards.count() == 40_000 and shards.groupBy("part").count().select(F.max("count")).first()[0] == 1000


def test_shards_of_a_table_with_columns_of_their_names(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k} " * 20, k, "x", "y", 1.5) for k in range(60)],
                               "doc_id long, text string, part int, shard string, hash string, `a.b` double")
    sharding.write_shards(df, str(tmp_path / "out"), 2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*df.columns, "shard_", "part_"} and back.count() == 60
    assert sorted(map(tuple, back.select(*[f"`{c}`" for c in df.columns]).collect())) == sorted(map(tuple, df.collect()))
    empty = str(tmp_path / "empty")
    sharding.write_shards(df.limit(0), empty, 2000)
