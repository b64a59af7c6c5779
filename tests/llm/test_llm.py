"""The operators against brute force and on awkward inputs."""

import random
import textwrap

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from areaqual.llm import components, embedding_dups, language, licenses, line_dedup, mixing, queries, sharding, simhash, topk, toxicity
from areaqual.llm import sentencepiece_codec as codec

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id int"


def docs(spark, texts, sources=None):
    rows = [(k if k != 3 else None, t, "en", (sources or ["a"] * len(texts))[k], len(t or ""), "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = ["", None, " \n\t ", "same text here now", "same text here now", "same text here now", "word " * 30_000, "é😀\u0000▁x", "漢字"]


def test_components_match_a_plain_search(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100, 100 + k) for k in range(50)]
    best = {n: n for e in edges for n in e}
    for _ in best:
        for a, b in edges:
            best[a] = best[b] = min(best[a], best[b])
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in got.collect()} == {n: best[n] for n in linked}


def test_cross_parsing_counts_phrases_like_a_plain_parser():
    sample, text = "the cat sat on the mat and the dog ran", "the cat ran on and on zz the mat"
    model = language.automata({"x": [sample]}, 1000, 62)
    plain = language.symbols_of(sample, model.symbols).tobytes()
    left, phrases = language.symbols_of(text, model.symbols).tobytes(), 0
    while left:
        n = 1
        while n < min(len(left), 12) and left[: n + 1] in plain:
            n += 1
        left, phrases = left[n:], phrases + 1
    assert language.phrase_counts([text], model, 4096, 12)[0][0, 0] == phrases


def plain_phrases(text, sample, longest):
    found, at = 0, 0
    stretches = {tuple(sample[a : a + n]) for a in range(len(sample)) for n in range(1, longest + 1)}
    while at < len(text):
        n = 1
        while n < longest and at + n < len(text) and tuple(text[at : at + n + 1]) in stretches:
            n += 1
        found, at = found + 1, at + n
    return found


SCRIPTS = {"ar": range(0x0627, 0x063B), "el": range(0x03B1, 0x03CA), "en": range(0x61, 0x7B), "ja": range(0x4E00, 0x4F00), "ru": range(0x0430, 0x0450), "zh": range(0x4E80, 0x4F80)}


def script_text(rng, name, size):
    words = ["".join(chr(rng.choice(SCRIPTS[name])) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(size)), " ".join(rng.choice(words) for _ in range(20)).upper()


@pytest.mark.parametrize("letters", [0, 1, 30, 62, 5000])
def test_every_letter_of_the_samples_counts(letters):
    rng = random.Random(9)
    made = {name: script_text(rng, name, 150) for name in SCRIPTS}
    texts = [t for _, t in made.values()] + ["\u0130 ΟΔΟΣ ж 漢 한국 x", ""]
    model = language.automata({name: [s] for name, (s, _) in made.items()}, 5000, letters)
    coded = [language.symbols_of(t, model.symbols).tolist() for t in texts]
    counts = language.phrase_counts(texts, model, 4096, 12)[0]
    for k, name in enumerate(model.languages):
        sample = language.symbols_of(made[name][0], model.symbols).tolist()
        assert language.OTHER not in sample
        assert counts[k].tolist() == [plain_phrases(t, sample, 12) for t in coded]


def test_languages_of_many_scripts(spark):
    rng = random.Random(9)
    made = {name: script_text(rng, name, 900) for name in SCRIPTS}
    rows = [(k, s, name) for k, (name, (s, _)) in enumerate(made.items())] + [(100 + k, t, name) for k, (name, (_, t)) in enumerate(made.items())]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn_languages(table, F.col("doc_id") < 100)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(table, model).collect()}
    assert got == {k: name for k, _, name in rows}


def test_language_of_awkward_texts(spark):
    model = language.automata({"en": ["the house and the tree"], "de": ["das haus und der baum"]}, 1000, 62)
    got = language.identify_language(docs(spark, ["the tree", "der Baum", *AWKWARD]), model, window=64).collect()
    assert [r["lang_pred"] for r in got][:5] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 2 + len(AWKWARD)
    none = language.learn_languages(docs(spark, []), F.lit(True))
    assert [r["lang_pred"] for r in language.identify_language(docs(spark, ["a"]), none).collect()] == ["und"]


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_finds_every_link(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(80)]
    texts = list(AWKWARD)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(5):
            copy = list(base)
            copy[rng.randrange(300)] = "x"
            texts.append(" ".join(copy))
    ids = [k if k != 3 else None for k in range(len(texts))]
    prints = [plain_print(t) for t in texts]
    best = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    best[a] = best[b] = min(best[a], best[b])
    least = {c: min(ids[k] for k in range(len(texts)) if best[k] == c and ids[k] is not None) for c in set(best)}
    table = docs(spark, texts)
    got = simhash.near_duplicates(table).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {
        (ids[k], f"{prints[k]:016x}", least[best[k]]) for k in range(len(texts))
    }
    kept = simhash.keep_one(table)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values()) and kept.columns == table.columns
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_rows_that_share_an_id_stay_in_each_group(spark):
    text = lambda seed: " ".join(f"w{random.Random(seed).randrange(10**6) + k * 7919 * seed}" for k in range(60))
    rows = [(7, text(1)), (7, text(2)), (7, text(2)), (7, None), (50, text(1))]
    want = [(7, text(1)), (7, text(2)), (7, None)]
    for k in range(10):  # the first text of these ids is in the group of a smaller one
        rows += [(20 + k, text(200 + k)), (20 + k, text(100 + k)), (8 + k, text(200 + k))]
        want += [(20 + k, text(100 + k)), (8 + k, text(200 + k))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + 0.02 * rng.normal(size=(30, 16)), np.repeat(base[:1], 40, 0) + 0.01 * rng.normal(size=(40, 16))])
    rows = [(k, v.tolist(), k % 2 if k >= 200 else 1, "") for k, v in enumerate(x.astype(np.float32))]
    rows += [(500, rows[0][1], 1, ""), (501, [0.0] * 16, 1, ""), (502, None, 1, ""), (503, [float("nan")] * 16, 1, ""), (504, rows[0][1], None, ""), (505, [None] * 16, 1, "")]
    y = np.array([r[1] for r in rows[:131]], np.float64)
    unit = y / np.linalg.norm(y, axis=1)[:, None]
    hit = unit @ unit.T >= 0.98
    got = {r["vec_id"]: r for r in embedding_dups.near_duplicates(vectors(spark, rows)).collect()}
    assert [got[r[0]]["n_links"] for r in rows[:131]] == (hit.sum(1) - 1).tolist()
    assert got[500]["component_id"] == 0 and not got[500]["kept"] and got[0]["kept"]
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in (501, 502, 503, 504, 505))
    assert embedding_dups.near_duplicates(vectors(spark, [])).count() == 0


def skewed_vectors():
    """One large group of near-copies, and pairs."""
    rng = np.random.default_rng(7)
    pairs = np.repeat(rng.normal(size=(120, 16)), 2, 0)
    pairs[1::2] += 0.02 * rng.normal(size=(120, 16))
    x = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 200, 0) + 0.01 * rng.normal(size=(200, 16)), pairs])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return [(k, v.tolist(), 1, "") for k, v in enumerate(x)], (unit @ unit.T >= 0.98).sum(1) - 1


@pytest.mark.parametrize("hot, pairs, least, most", [(1.0, 0.0, 0.0, 0.05), (1.0, 1.0, 1.0, 1.0), (0.5, 1.0, 0.4, 0.6), (1.0, 0.75, 0.7, 0.8)])
def test_audit_sees_small_groups(spark, hot, pairs, least, most):
    rows, real = skewed_vectors()
    classes = embedding_dups._classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string"))
    share = [hot if k < 200 else float((k - 200) // 2 % 4 < 4 * pairs) for k in range(len(rows))]
    counts = spark.createDataFrame([(k, int(real[k] * share[k])) for k in range(len(rows))], "node long, found long")
    assert least <= embedding_dups._audit(classes, counts, embedding_dups.Settings()) <= most


def test_links_over_several_clusters_and_shards(spark):
    rows, real = skewed_vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string")
    got = embedding_dups.near_duplicates(table, embedding_dups.Settings(cluster_rows=40, shard_rows=30)).collect()
    found = np.array([r["n_links"] for r in sorted(got)])
    assert (found <= real).all() and (found / real)[:200].mean() >= 0.9 and (found / real)[200:].mean() >= 0.9
    assert all(r["audit_recall"] >= 0.9 for r in got)


def test_too_small_a_recall_is_told(spark):
    rows, _ = skewed_vectors()
    table = spark.createDataFrame(rows[:30], "vec_id long, embedding array<double>, label int, kept string")
    with pytest.warns(UserWarning, match="widest search has a recall"):
        embedding_dups.near_duplicates(table, embedding_dups.Settings(recall=1.1))


@pytest.mark.parametrize("shard, block, leaf", [(8192, 2048, 256), (40, 5, 7)])
def test_top_k_matches_brute_force(spark, shard, block, leaf):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(150, 8)) * 2) / 16
    rows = [(k, v.tolist(), 0, "") for k, v in enumerate(x)] + [(7, x[7].tolist(), 0, ""), (900, None, 0, ""), (901, [float("inf")] * 8, 0, ""), (940, [1.0], 0, "")]
    got = topk.top_k(topk.quantized(vectors(spark, rows)), F.col("vec_id") % 20 == 0, 20, shard, block, leaf).collect()
    q = np.floor(64 * x).astype(int)
    want = set()
    for k in range(0, 150, 20):
        score = q @ q[k]
        order = [j for j in np.lexsort((np.arange(150), -score)) if j != k][:20]
        want |= {(k, r + 1, int(j), int(score[j])) for r, j in enumerate(order)}
    assert {tuple(r) for r in got} == want


def plain_deletions(texts, least):
    """Lines that are part of a run of so many words with an earlier copy."""
    rows = [(k, [(n, x.strip()) for n, x in enumerate(t.split("\n")) if x.strip()]) for k, t in enumerate(texts)]
    seen, gone = set(), set()
    for k, lines in rows:
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone |= {(k, n) for n, _ in lines[a:b]}
                    seen.add(run)
    return gone


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    for _ in range(3):
        texts = ["\n".join(rng.choice(["a", "b b", "c c c", "", "d d d d d"]) for _ in range(rng.randrange(12))) for _ in range(12)]
        table = docs(spark, [t if k != 3 else "" for k, t in enumerate(texts)])
        texts[3] = ""
        for least in (1, 4, 7):
            got = set()
            for r in line_dedup.repeated_runs(table, least).collect():
                lines = texts[r["doc_id"]].split("\n")
                got |= {(r["doc_id"], n) for n in range(r["first"], r["last"] + 1) if lines[n].strip()}
            same = {t: k for k, t in reversed(list(enumerate(texts)))}
            assert len(same) <= len(texts)
            assert got == plain_deletions(texts, least)


def test_line_dedup_of_awkward_texts(spark):
    table = docs(spark, AWKWARD)
    got = {r["doc_id"]: r for r in line_dedup.delete_repeats(table, 3).collect() if r["doc_id"] is not None}
    assert got[4]["text"] == "" and got[4]["n_chars"] == 0 and got[1]["text"] is None and got[6]["text"] == AWKWARD[6]
    assert line_dedup.delete_repeats(docs(spark, [])).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    texts = [*AWKWARD, *["w " * rng.randrange(1, 90) for _ in range(600)]]
    table = docs(spark, texts, [rng.choice(["a", "b", "c", "d", None]) for _ in texts])
    got, again = mixing.mix(table).collect(), mixing.mix(table.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(texts)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    for s in ("a", "b", "c", "d", None):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    assert mixing.mixed(table).columns == table.columns and mixing.mixed(docs(spark, [])).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    units = spark.createDataFrame([("a", 100, 1), ("b", 1, 1), ("c", 10, 1)], "source string, size long, n long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(units, 3.0).collect()}
    assert got == {"a": pytest.approx(78), "b": pytest.approx(3), "c": pytest.approx(30)}


def test_toxicity_learns_and_survives_awkward_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["tree", "house", "river"]) for _ in range(20)) + (" you badword!" if k % 4 == 0 else "") for k in range(400)]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(table, labels, F.col("doc_id") % 3 != 1, trees=3)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(table, model).collect()}
    assert all(got[k]["predicted"] == int(k % 4 == 0) for k in range(400) if k != 3)
    odd = toxicity.score_toxicity(docs(spark, AWKWARD), model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in odd)
    none = toxicity.learn_toxicity(table, labels.limit(0), F.lit(True))
    assert toxicity.drop_toxic(table, none).count() == 400


def test_shards_fit(spark):
    table = docs(spark, [*AWKWARD, *["x" * 100] * 300])
    got = sharding.assign_shards(table.withColumn("doc_id", F.when(F.col("doc_id") > 20, 99).otherwise(F.col("doc_id"))), 1000)
    sums = got.groupBy("depth", "prefix", "part").agg(F.sum("bytes").alias("b"), F.max("shard_bytes").alias("s"), F.count("*").alias("n"))
    assert got.count() == table.count()
    assert all(r["b"] == r["s"] and (r["b"] <= 1000 or r["n"] == 1) for r in sums.collect())
    assert sharding.assign_shards(docs(spark, []), 10).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    table = docs(spark, ["some text"] * 3 + ["other " * k for k in range(40)])
    sharding.write_shards(table, str(tmp_path / "out"), 500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(table.columns).collect())) == sorted(map(str, table.collect()))


def test_written_folders_keep_the_limit(spark, tmp_path):
    texts = ["some text"] * 5 + ["other " * k for k in range(40)] + ["x" * 100] * 303 + ["long " * 300] * 3 + [None, "", None]
    ids = [k if t is None or not t.startswith(("x", "long")) else None if t[0] == "x" else 7 for k, t in enumerate(texts)]
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(7)
    sharding.write_shards(table, str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, table.collect()))
    of = F.coalesce(F.octet_length("text"), F.lit(0)).alias("b")
    sums = back.groupBy("shard", "part").agg(F.sum(of).alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 1000 or r["n"] == 1 for r in sums)
    there = sharding.assign_shards(table, 1000).select("depth", "prefix", "part", "shard_bytes", "shard_docs").distinct()
    assert sorted((r["b"], r["n"]) for r in sums) == sorted((r["shard_bytes"], r["shard_docs"]) for r in there.collect())
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in (tmp_path / "out").glob("shard=*/part=*"))


def test_equal_rows_are_numbered_over_chunks(spark):
    rows = spark.range(500, numPartitions=9).select("id", F.lit(4).alias("__per_part"), (F.col("id") % 3).alias("__hash"), F.lit(1).alias("__bytes"))
    counts = sharding._dealt(rows, 2).groupBy("__hash", "part").count().collect()
    full = {(h, p): 4 for h, n in ((0, 167), (1, 167), (2, 166)) for p in range(n // 4)}
    assert {(r["__hash"], r["part"]): r["count"] for r in counts} == full | {(0, 41): 3, (1, 41): 3, (2, 41): 2}


def test_licence_rules(spark):
    s = licenses.SENTENCES
    mit = f"{s['mit-name']}\n{s['mit-grant']} {s['mit-include']}"
    texts = ["Text. " + s["gpl-3-notice"] + " More.", mit, f"{s['mit-include']} {s['mit-grant']}", s["mit-grant"], *AWKWARD]
    table = docs(spark, texts).withColumn("doc_id", F.coalesce("doc_id", F.lit(3)))
    got = {(r["doc_id"], r["rule"]) for r in licenses.scan_licences(table).collect()}
    assert got == {(0, "gpl-3-notice"), (1, "mit-named-text")}


def rules_found(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.scan_licences(table).collect()
    return [sorted(r["rule"] for r in found if r["doc_id"] == k) for k in range(len(texts))]


@pytest.mark.parametrize("between", [" ", "\n", "\n\n", "\n# \n# "])
def test_every_rule_matches_its_own_sentences(spark, between):
    texts = [between.join(licenses.SENTENCES[k] for k in sids) for _, _, sids in licenses.RULES]
    if between == " ":  # titles end at line ends only
        texts = [t.replace("The MIT License (MIT) ", "The MIT License (MIT)\n").replace("MIT License Perm", "MIT License\nPerm") for t in texts]
        texts = [t.replace("License at Unless", "License at\nUnless") for t in texts]
    assert rules_found(spark, texts) == [[rule] for rule, _, _ in licenses.RULES]


@pytest.mark.parametrize("width, mark", [(70, ""), (80, ""), (76, "# "), (72, " * "), (20, "")])
def test_wrapped_licences(spark, width, mark):
    s, lines = licenses.SENTENCES, lambda *parts: "\n".join(mark + x for p in parts for x in (textwrap.wrap(p, width) if p else [""]))
    bsd = [s["bsd-grant"], "", "1. " + s["bsd-source"], "2. " + s["bsd-binary"]]
    texts = [
        lines("The MIT License (MIT)", "", "Copyright (c) 2020 Someone", "", s["mit-grant"], "", s["mit-include"], "", "THE SOFTWARE IS PROVIDED"),
        lines("MIT License", s["mit-grant"], s["mit-include"]),
        lines("Copyright 2020 Someone", "", *bsd),
        lines("Copyright 2020 Someone", "", *bsd, "3. " + s["bsd-names"]),
        lines("x", *bsd, "3. " + s["bsd-names-university"], "", "y"),
        lines(s["apache-2.0-grant-full"] + " " + s["apache-2.0-obtain"], "", "http://example.org/LICENSE-2.0", "", s["apache-2.0-as-is"] + " " + s["apache-2.0-see"]),
        lines(s["gpl-free"], "", s["gpl-hope"] + " " + s["gpl-see"]),
        lines(s["mit-grant"].replace("to deal in", "", 1), s["mit-include"]),
        s["mit-grant"].replace("person obtaining", "person\n\nobtaining") + "\n" + s["mit-include"],
    ]
    want = ["mit-titled-text", "mit-named-text", "bsd-2-text", "bsd-3-text", "bsd-3-text-university", "apache-2.0-header", "gpl-3-header"]
    got = rules_found(spark, texts)
    assert got == [[w] for w in want] + [[], []]


def test_pieces_of_a_known_sentence_stand_together(spark):
    texts = ["SPDX-License-Identifier: Foo\nMIT", "SPDX-License-Identifier:\nMIT", "SPDX-License-Identifier: MIT OR Foo", "x\n// SPDX-License-Identifier: MIT\ny"]
    assert rules_found(spark, texts) == [[], ["mit-spdx"], [], ["mit-spdx"]]


def test_pieces_are_those_of_merging():
    v, sp = codec.load_vocabulary(queries.TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    rng = random.Random(6)
    parts = ["a" * 17, " ", "  ", "\n", "the", "ing", "é", "😀", "漢字", "=" * 9, "\t", "1234", "th", "eer", "², .", "x.y,z"]
    for k in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(50)))
        text = text.replace(" ", "") if k % 2 else text
        ids = np.frombuffer(codec.encode_text(text, v), np.int32).tolist()
        assert ids == sp.encode(text) and codec.decode_ids(ids, v) == text
    ids = sp.encode("the tree")
    assert codec.decode_ids([], v) == "" and codec.decode_ids([-1, *ids, len(v.pieces)], v) == "the tree"  # unknown ids: nothing
    long = "the" * 2000  # no space: committed where the paths meet
    assert len([x for x in codec.stream(long, v) if x]) > 10
    assert [i for x in codec.stream(codec.SPACE + long, v) for i in x] == sp.encode(long)


def test_encoding_awkward_texts(spark):
    coded = codec.encode(docs(spark, AWKWARD), queries.TOKENIZER, ("doc_id", "n_chars"))
    rows = coded.collect()
    assert [r["exact"] for r in rows] == [None if t is None else True for t in AWKWARD]
    assert [r["text"] for r in codec.decode(coded, queries.TOKENIZER).collect()] == AWKWARD


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    result = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    got = queries.QUERIES[name](spark, d).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())


def test_pipeline_keeps_clean_documents(spark):
    out = queries.QUERIES["pipeline"](spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and all(r["exact"] for r in rows)
