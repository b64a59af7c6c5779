"""Order MinHash against a plain version, and on awkward inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaqual.llm import order_minhash as om

SCHEMA = "doc_id long, text string, fingerprint string, part int, hash long"
M64 = (1 << 64) - 1


def mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def plain(text, sketch):
    """Each k-mer with its number, the least ones of every order in the order of the text, hashed."""
    k = min(sketch.k, len(text))
    kmers = [text[i : i + k] for i in range(len(text) - k + 1)] if text else []
    first, second = (x.tolist() for x in sketch.orders())

    def hashed(kmer):
        h = k
        for c in kmer:
            h = (h * 0x100000001B3 + ord(c)) & M64
        return mix(h)

    seen, numbered = {}, []
    for at, kmer in enumerate(kmers):
        numbered.append((at, mix((hashed(kmer) + seen.get(kmer, 0) * 0x9E3779B97F4A7C15) & M64) >> 32))
        seen[kmer] = seen.get(kmer, 0) + 1
    parts = []
    for a, b in zip(first, second):
        least = sorted(numbered, key=lambda x: ((x[1] ^ a) * b & M64 >> 32, x[0]))[: sketch.chosen]
        part = 0
        for at, _ in sorted(least):
            part = mix((part * 0x100000001B3 + hashed(kmers[at])) & M64)
        parts.append(part >> 48 if kmers else 0)
    return parts


@pytest.mark.parametrize("sketch", [om.Sketch(), om.Sketch(3, 1, 16), om.Sketch(4, 3, 20, 7)])
def test_fingerprint_is_that_of_a_plain_version(sketch):
    rng = random.Random(3)
    texts = ["", "a", "ab", "abcdef", "abababababab", "é😀漢\u0000 x", " ".join(rng.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(90))]
    for text in texts:
        for at_once in (1, 100, 1 << 16):
            assert om.order_minhash(om.code_points(text), sketch, at_once).tolist() == plain(text, sketch)


def test_order_matters_beside_the_set():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}x" for _ in range(400)]
    text, moved = " ".join(words), " ".join(words[200:] + words[:200])
    few = " ".join(w if k % 40 else "new" for k, w in enumerate(words))
    a, b, c = (om.order_minhash(om.code_points(t), om.Sketch(count=256)) for t in (text, moved, few))
    assert 0.3 < om.likeness(a, b) < 0.7  # the same k-mers, half of the pairs in the other order
    assert om.likeness(a, c) > om.likeness(a, b) and om.likeness(a, a) == 1.0


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def plain_report(rows, sketch):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        prints = [om.order_minhash(om.code_points(t), sketch) for t in (text, changed, after)]
        digest = hashlib.sha256(changed.encode()).hexdigest()
        near = [float((prints[0] == p).mean()) for p in prints[1:]]
        out.append((i, len(text), digest, om.spelled(prints[0]).hex(), om.spelled(prints[1]).hex(), *near))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,parts", [(1, 1), (2, 2), (60, 1), (60, 7), (300, 16)])
def test_edit_likeness_is_that_of_a_plain_version(spark, size, parts):
    rng = random.Random(size)
    texts = ["", None, "a", "é😀" * 50, "long " * 9_000]
    rows = [(k * 3 - 20, texts[k - 6] if 5 < k < 6 + len(texts) else " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randrange(60)))) for k in range(size)]
    if size > 2:
        rows[0] = (None, rows[0][1])
    rng.shuffle(rows)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = om.edit_likeness(rows_of(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert sorted(map(tuple, got), key=str) == plain_report(rows, om.Sketch())


def test_rows_of_one_id_spread_and_follow_each_other(spark):
    same = [(7, "the same text in many rows")] * 400 + [(7, f"text number {k}") for k in range(400)] + [(1, "last"), (9, "first")]
    got = om.edit_likeness(rows_of(spark, same).repartition(16)).collect()
    assert len(got) == len(same)
    copies = [r for r in got if r["n_chars"] == len("the same text in many rows")]
    assert len(copies) == 400 and sum(r["near_next"] == 1.0 for r in copies) >= 399


def test_empty_table_and_columns(spark):
    report = om.edit_likeness(rows_of(spark, []))
    assert report.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert report.collect() == [] and om.fingerprints(rows_of(spark, [])).collect() == []


def test_fingerprints_and_likeness_of_columns(spark):
    texts = [(1, "one text of some words"), (2, "one text of some words"), (3, None), (4, ""), (5, "one text of other words")]
    prints = om.fingerprints(rows_of(spark, texts))
    got = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    assert got[1] == got[2] and got[3] == got[4] == "0" * 256 and got[5] != got[1]
    a, b = prints.toDF("a_id", "a_n", "a"), prints.toDF("b_id", "b_n", "b")
    near = a.crossJoin(b).select("a_id", "b_id", om.likeness_of(F.col("a"), F.col("b"), om.Sketch()).alias("near"))
    bits = {k: np.frombuffer(bytes.fromhex(v), ">u2") for k, v in got.items()}
    for r in near.collect():
        assert r["near"] == om.likeness(bits[r["a_id"]], bits[r["b_id"]])
