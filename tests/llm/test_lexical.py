"""Ranked lexical search against a plain scorer, and on awkward inputs."""

import collections
import math
import random
import re

import numpy as np
import pytest

from areaqual.llm import lexical
from areaqual.llm.queries import ORACLES, QUERIES

TERM = re.compile(lexical.TERM)


def plain_terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(folded)


def plain(docs, items, k):
    held = [(i, collections.Counter(t)) for i, text in docs if (t := plain_terms(text))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        query, found = collections.Counter(plain_terms(text)), []
        df = {t: sum(t in c for _, c in held) for t in query}
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in query}
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(q * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in query.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 5, 6, "z") for i, t in docs], "doc_id long, text string, m long, n long, term string"),
        spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, w long"),
    )


def test_terms_are_those_of_the_pattern():
    texts = ["", None, "Ab1_c-d É'x 漢字😀Z\u0000\u007f\u0080~", "İI ẞ ｄ", "".join(map(chr, range(0x300)))]
    for text in texts:
        assert [t.decode() for t in lexical.terms_of(text)] == plain_terms(text)


@pytest.mark.parametrize("block_terms,k", [(1, 3), (40, 1), (200, 10), (1 << 20, 10), (1 << 20, 1000)])
def test_search_is_that_of_a_plain_scorer(spark, block_terms, k):
    rng = random.Random(block_terms)
    words = [f"W{x}" for x in range(30)] + ["É", "漢字", "a-b"]
    docs = [(x, " ".join(rng.choices(words, [1 / (1 + y) for y in range(len(words))], k=rng.randrange(1, 40)))) for x in range(150)]
    docs += [(200, None), (201, ""), (202, " .,-"), (None, "W1 w2 w3"), (203, "w1 " * 20_000), (204, "W1 W2"), (204, "w1 w2"), (5, "w29")]
    docs += [(300 + x, docs[7][1]) for x in range(30)]  # ties
    items = [(x, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for x in range(15)]
    items += [(90, None), (91, ""), (92, "unknown words"), (93, "w1 w1 w1 w2"), (None, "w5")]
    d, q = tables(spark, docs, items)
    got = lexical.search(lexical.build_index(d.repartition(5), block_terms, block_terms), q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(docs, items, k), key=str)


def test_queries_in_parts_give_the_same(spark):
    docs = [(x, f"alpha b{x % 7} c{x % 5}") for x in range(60)]
    items = [(x, f"alpha b{x % 7} c1") for x in range(20)]
    d, q = tables(spark, docs, items)
    index = lexical.build_index(d)
    assert sorted(lexical.search(index, q, 4, block_bytes=200).collect()) == sorted(lexical.search(index, q, 4).collect())


def test_a_bound_ends_the_visits_and_an_impact_is_computed_once():
    m = np.repeat([30, 60, 90, 400, 800], 50)
    shard = lexical.Shard(list(range(250)), m, ["a"], np.array([0, 250]), np.arange(250), np.ones(250, np.int64))
    visited = []
    visit = shard._visit
    shard._visit = lambda at, *rest: visited.extend(at.tolist()) or visit(at, *rest)
    found = shard.better([("a", 9)], 10, [])
    assert visited == [0] and [i for _, _, i in found] == list(range(10))
    places, values, strata, begin, highest = shard.lists["a"]
    assert len(strata) == 5 and len(set(values.tolist())) == 5 and highest.tolist() == lexical.impact(np.ones(5, np.int64), np.unique(m)).tolist()


def test_documents_of_one_length_are_dealt_to_blocks(spark):
    docs = [(x, f"t{x} u{x % 3} v") for x in range(3000)]
    d, q = tables(spark, docs, [(1, "t17 u2"), (2, "v")])
    index = lexical.build_index(d.repartition(8), 300, 100)
    sizes = [len(r["doc_id"]) for r in index.strata.collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 134
    assert sorted(map(tuple, lexical.search(index, q, 3).collect())) == sorted(plain(docs, [(1, "t17 u2"), (2, "v")], 3))


def test_empty_tables(spark):
    d, q = tables(spark, [], [])
    full, asked = tables(spark, [(1, "a b")], [(1, "a")])
    assert lexical.ranked_search(d, q).collect() == lexical.ranked_search(d, asked).collect() == lexical.ranked_search(full, q).collect() == []


def test_query_and_sql_agree(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(ORACLES["op13_lexical_search"]).fetchall()
    assert sorted(map(tuple, QUERIES["op13_lexical_search"](spark, folder).collect())) == sorted(want)
