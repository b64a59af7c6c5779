"""Unigram models, written by hand, against the library."""

import random
import struct

import numpy as np
import pytest
import sentencepiece

from areaqual.llm import sentencepiece_codec as codec

NORMAL, UNK, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def number(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def message(*fields):
    """Fields as (number, value): whole numbers, floats, texts or messages."""
    out = b""
    for k, value in fields:
        if isinstance(value, float):
            out += number(k << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += number(k << 3) + number(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += number(k << 3 | 2) + number(len(value)) + value
    return out


def model(pieces, kind=1, fallback=1, dummy=1, drop=0, normaliser=b"", extra=()):
    every = [("<unk>", 0.0, UNK), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL), *[(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)]]
    every += [(p, s, NORMAL) for p, s in pieces.items()] + list(extra)
    listed = [(1, message((1, p), (2, s), (3, t))) for p, s, t in every]
    trainer = message((3, kind), (4, len(every)), (35, fallback), (40, 0), (41, 1), (42, 2), (43, 18446744073709551615))
    rules = message((1, "identity"), (2, normaliser), (3, dummy), (4, drop), (5, 1))
    return message(*listed, (2, trainer), (3, rules))


def random_pieces(rng):
    letters = "abcdeé漢▁"
    pieces = {c: -rng.uniform(2, 6) for c in letters}
    for _ in range(120):
        word = ("▁" if rng.random() < 0.4 else "") + "".join(rng.choice(letters[:-1]) for _ in range(rng.randrange(1, 6)))
        pieces[word] = -rng.uniform(1, 9)
    return pieces | {"aa": -3.0, "aaa": -4.5, "aaaa": -6.0, "▁▁": -3.0}  # sums that tie


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_are_those_of_the_library(tmp_path, seed):
    rng = random.Random(seed)
    path = tmp_path / "unigram.model"
    path.write_bytes(model(random_pieces(rng)))
    library, v = sentencepiece.SentencePieceProcessor(model_file=str(path)), codec.load_vocabulary(str(path))
    assert v.kind == "unigram"
    texts = ["", "a", " ", "zzz", "a  b\n漢x é", "aaaaaaaaaaaaa", "😀 unknown", "a" * 5000, " " * 300 + "abc"]
    texts += ["".join(rng.choice("aaabbcdeé漢  xyz😀") for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    for text in texts:
        ids = np.frombuffer(codec.encode_text(text, v), np.int32)
        assert ids.tolist() == library.encode(text), text
        assert codec.decode_ids(ids, v) == text


def test_a_long_text_without_spaces_keeps_a_bounded_window(tmp_path):
    rng = random.Random(7)
    path = tmp_path / "unigram.model"
    path.write_bytes(model(random_pieces(rng)))
    v = codec.load_vocabulary(str(path))
    text = "".join(rng.choice("abcdeé漢x") for _ in range(200_000))
    sizes = [sum(len(v.pieces[i]) for i in ids) for ids in codec.stream_by_score(text, v)]
    assert len(sizes) > 1000 and max(sizes) < 200 * v.longest


def test_spark_encodes_by_score(spark, tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(model(random_pieces(random.Random(5))))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    docs = spark.createDataFrame([(1, "abc aaa"), (2, None), (3, ""), (4, "a▁b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in codec.encode(docs, str(path)).collect()}
    assert got[1]["ids"] == library.encode("abc aaa") and got[2]["ids"] is None and got[3]["ids"] == []
    assert all(got[k]["exact"] for k in (1, 3, 4))
    back = codec.decode(codec.encode(docs, str(path)), str(path))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "abc aaa", 2: None, 3: "", 4: "a▁b"}


@pytest.mark.parametrize("settings,said", [
    ({"kind": 3}, "kind"), ({"fallback": 0}, "byte fallback"), ({"dummy": 0}, "no space"), ({"drop": 1}, "drops"),
    ({"normaliser": b"x"}, "normaliser"), ({"extra": [("added", 0.0, USER)]}, "users"),
])
def test_models_that_are_not_handled_are_refused(settings, said):
    with pytest.raises(ValueError, match=said):
        codec.model_kind(model({"a": -1.0}, **settings))
