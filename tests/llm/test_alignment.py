"""Cross-tokenizer alignment against a plain version by spans, and on awkward inputs."""

import collections
import hashlib
import json
import random

import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from areaqual.llm import alignment
from areaqual.llm.queries import BYTE_TOKENIZER, TOKENIZER

AWKWARD = [
    None, "", " ", "a▁b", "x <|endoftext|> <s> <0x41> </s> <unk>", " " * 5000, "é😀\u0000 漢字 ﬁ", "tab\tand\r\nline", "x" * 3000,
    "don't we'll I'M 12 345", "same text", "same text", "\n\n  \n", "ⅷ ½ ٣ नमस्ते", "  wide",
]


def spans(pieces):
    at = 0
    for p in pieces:
        yield at, at + len(p)
        at += len(p)


def plain_tokens(text):
    letters = {c: b for b, c in alignment.byte_letters().items()}
    a = tokenizers.Tokenizer.from_file(BYTE_TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    whole = (" " + text).encode()
    return (ids_a, ids_b, bytes_a, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def plain_row(text):
    """Groups as text, and links as id pairs."""
    found = plain_tokens(text)
    if not found:
        return [], [], [], []
    ids_a, ids_b, bytes_a, bytes_b = found
    at_a, at_b = list(spans(bytes_a)), list(spans(bytes_b))
    links = [(x, y) for x, (s, e) in zip(ids_a, at_a) for y, (t, f) in zip(ids_b, at_b) if s < f and t < e]
    groups, begin = [], 0
    for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
        sides = [[x for x, (s, e) in zip(ids, at) if begin <= s and e <= end] for ids, at in ((ids_a, at_a), (ids_b, at_b))]
        groups.append("|".join(",".join(map(str, side)) for side in sides))
        begin = end
    return ids_a, ids_b, groups, links


def plain(rows):
    made = [(i, *plain_row(text)) for i, text in rows]
    count = collections.Counter(x for m in made for x in m[4])
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [
        (i, len(a), len(b), len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x),
         hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, a, b, g, x in made
    ]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, place int, known string")


@pytest.mark.parametrize("chunk_bytes", [1, 300, 1 << 22])
def test_counts_are_those_of_a_plain_version(spark, chunk_bytes):
    rng = random.Random(5)
    letters = "abcdefghij éß漢😀'.,0123  \n"
    rows = [(k, t) for k, t in enumerate(AWKWARD)] + [(None, "no id here")]
    rows += [(100 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(200)))) for k in range(40)]
    got = alignment.alignment_counts(table(spark, rows), BYTE_TOKENIZER, TOKENIZER, chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


def test_groups_hold_the_bytes_of_the_text(spark):
    rows = [(k, t) for k, t in enumerate(AWKWARD)]
    entries = [alignment.Encoder(open(p, "rb").read(), alignment._kind(p)).entries for p in (BYTE_TOKENIZER, TOKENIZER)]
    for r in alignment.align(table(spark, rows), BYTE_TOKENIZER, TOKENIZER).collect():
        whole = (" " + (AWKWARD[r["doc_id"]] or "")).encode()
        assert r["a_ids"] == plain_row(AWKWARD[r["doc_id"]])[0]
        for g in r["groups"]:
            for side, known in zip("ab", entries):
                ids = r[f"{side}_ids"][g[f"{side}_from"] : g[f"{side}_to"]]
                assert b"".join(known[k] for k in ids) == whole[g["start"] : g["end"]]


def test_every_code_point_gets_the_ids_of_the_slower_library():
    encoder = alignment.Encoder(open(BYTE_TOKENIZER, "rb").read(), "byte")
    assert encoder._fast is not None
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}b  {chr(c)}." for c in points]
    slow = encoder._library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    assert [encoder.encode(t).tolist() for t in texts] == [s.ids for s in slow]


def test_a_vocabulary_with_other_settings_takes_the_slower_library():
    given = json.load(open(BYTE_TOKENIZER))
    given["model"]["ignore_merges"] = True
    assert alignment.Encoder(json.dumps(given).encode(), "byte")._fast is None


def test_long_runs_of_blanks(spark):
    rows = [(1, " " * 200_000), (2, "\n" * 100_000 + "x"), (3, "ab" * 50_000)]
    got = alignment.alignment_counts(table(spark, rows), BYTE_TOKENIZER, TOKENIZER).orderBy("doc_id").collect()
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and r["n_groups"] for r in got)


def test_empty_table_and_only_rows_without_tokens(spark):
    assert alignment.alignment_counts(table(spark, []), BYTE_TOKENIZER, TOKENIZER).collect() == []
    assert alignment.align(table(spark, []), BYTE_TOKENIZER, TOKENIZER).collect() == []
    got = alignment.alignment_counts(table(spark, [(1, None), (2, "")]), BYTE_TOKENIZER, TOKENIZER, keep=("known", "doc_id"))
    assert sorted(map(tuple, got.collect())) == [("x", 1, *[0] * 6, ""), ("x", 2, *[0] * 6, "")]


def test_a_pair_in_every_text_is_one_row_a_chunk(spark):
    rows = [(k, "the same words again and again") for k in range(500)]
    got = alignment.alignment_counts(table(spark, rows), BYTE_TOKENIZER, TOKENIZER, chunk_bytes=2000)
    links = got.agg(F.min("count_sum"), F.max("count_sum"), F.min("n_links")).first()
    assert tuple(links) == (4 * 500 + 2 * 1000, 4 * 500 + 2 * 1000, 6)
