"""Joins whose sides Spark sizes too low must not be gathered to be broadcast."""

import re

from areaqual.llm import components, line_dedup, simhash
from areaqual.llm.common import stored


def plan(df):
    return df._jdf.queryExecution().toString()


def test_variants_of_fingerprints_are_not_broadcast(spark):
    prints = stored(spark.createDataFrame([(k,) for k in (0, 1, 3, 7, 15, 1 << 40)], "fp long"), "prints")
    pairs = simhash.links(prints, 3)
    assert not re.search("BroadcastHashJoin|BroadcastExchange", plan(pairs))
    near = {(a, b) for a in (0, 1, 3, 7, 15, 1 << 40) for b in (0, 1, 3, 7, 15, 1 << 40) if a < b and (a ^ b).bit_count() <= 3}
    assert sorted(map(tuple, pairs.collect())) == sorted(near)


def test_minima_of_links_are_not_broadcast(spark):
    links = stored(spark.createDataFrame([(k, k // 2) for k in range(1, 40)], "a long, b long"), "links")
    for star in (components._large_star(links), components._small_star(links)):
        assert not re.search("BroadcastHashJoin|BroadcastExchange", plan(star))


def test_ranks_of_lines_are_not_broadcast(spark):
    lines = "an old line of words\nand then one more line\nwhich goes on for long"
    docs = [(k, lines if k else f"first\n{lines}", len(lines)) for k in range(4)]
    table = stored(spark.createDataFrame(docs, "doc_id long, text string, n_chars int"), "docs")
    runs = line_dedup.repeated_runs(table, 5)
    assert not re.search("BroadcastHashJoin|BroadcastExchange", plan(runs))
    assert sorted((r["doc_id"], r["lines"]) for r in runs.collect()) == [(1, 3), (2, 3), (3, 3)]
