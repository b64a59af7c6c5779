"""SentencePiece encoding and decoding by streaming Viterbi.

A text is read once. For every boundary between characters the survivor is the one piece that ends there and may
follow the survivor of its own start; only boundaries that a further piece can still reach back to are held. As soon
as the paths of all held boundaries run through one boundary, the ids up to it are final.

A model is of one of two kinds. In a unigram model the survivor is the piece with the highest sum of scores up to it.
In a merge model a piece may follow another if merging their joined text gives back just these two; a text then has
one path of pieces that may follow each other, and it is what merging gives.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual.llm.common import col, ship

SPACE = "▁"  # stands for a space in pieces
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
MARK = "\udfff"  # stands for SPACE itself in what is encoded; no text can hold it
ship(__name__)


@dataclass
class Vocabulary:
    """Pieces and scores of a model, and what is derived from them."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  # of the 256 bytes
    idle: set[int]  # control and unknown pieces: never a result
    kind: str = "merge"  # or "unigram"
    ids: dict[str, int] = field(init=False)
    tree: dict[str, list] = field(init=False, default_factory=dict)  # character -> id or -1, and the tree behind it
    longest: int = field(init=False)
    parts: re.Pattern = field(init=False)
    follows: dict[int, bool] = field(init=False, default_factory=dict)  # by both ids in one number
    trees: dict[str, tuple[str, str] | None] = field(init=False, default_factory=dict)
    edges: dict[tuple[str, int], list | None] = field(init=False, default_factory=dict)
    known: Known = field(init=False)
    decoded: np.ndarray = field(init=False)  # of bytes

    def __post_init__(self) -> None:
        skip = self.idle | set(self.byte_ids)
        self.ids = {p: k for k, p in enumerate(self.pieces) if k not in skip}
        self.longest = max(map(len, self.ids), default=1)
        if self.kind == "merge":
            self.ids = {p: k for p, k in self.ids.items() if is_whole(p, self)}  # the others are never made
        for p, k in self.ids.items():
            here = self.tree
            for c in p:
                node = here.setdefault(c, [-1, {}])
                here = node[1]
            node[0] = k
        self.parts = re.compile(_parts(self.ids))
        self.known = Known(self)
        self.decoded = np.array([*(p.replace(SPACE, " ").encode() for p in self.pieces), b""], object)[:-1]
        for k in self.idle:
            self.decoded[k] = b""
        for b, k in enumerate(self.byte_ids):
            self.decoded[k] = bytes([b])


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a message in the protocol buffer format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            value = number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            value, at = message[at : at + size], at + size
        yield key >> 3, value


# Fixed values of the model format: fields of the model, its piece types, and the kinds of model.
PIECE, TRAINER, NORMALISER = 1, 2, 3
PIECE_TYPE, USER_DEFINED = 3, 4
KINDS = {1: "unigram", 2: "merge"}


def model_kind(model: bytes) -> str:
    """The kind of a model, or an error if it is one whose ids are not made here: another kind, a normaliser that changes
    texts, other rules for white space, no byte fallback, or pieces that users have added."""
    held: dict[int, dict] = {TRAINER: {}, NORMALISER: {}}
    added = 0
    for k, value in fields(model):
        if k in held:
            held[k] = dict(fields(value))
        elif k == PIECE:
            added += dict(fields(value)).get(PIECE_TYPE, 1) == USER_DEFINED
    trainer, rules = held[TRAINER], held[NORMALISER]
    kind = KINDS.get(trainer.get(3, 1))
    refused = {
        f"its kind is number {trainer.get(3, 1)}": kind is None, "it has no byte fallback": not trainer.get(35, 0),
        "white space follows its words": trainer.get(24, 0), "its normaliser changes texts": bool(rules.get(2, b"")),
        "it puts no space before texts": not rules.get(3, 1), "it drops white space": rules.get(4, 1),
        "it keeps spaces as they are": not rules.get(5, 1), "it has pieces added by users": added,
    }
    if any(refused.values()):
        raise ValueError("This model is not handled: " + "; ".join(text for text, found in refused.items() if found))
    return kind


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model with byte fallback; see :func:`model_kind` for what is refused."""
    import sentencepiece

    model = Path(path).read_bytes()
    kind = model_kind(model)
    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(k) for k in range(n)]
    by_name = {p: k for k, p in enumerate(pieces)}
    idle = {k for k in range(n) if m.is_control(k) or m.is_unknown(k) or m.is_unused(k)}
    return Vocabulary(pieces, [m.get_score(k) for k in range(n)], [by_name[f"<0x{b:02X}>"] for b in range(256)], idle, kind)


def _parts(ids: dict[str, int]) -> str:
    """A pattern that cuts a text only where no piece crosses: before spaces, at line ends, between a letter and a stop."""
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        return r"(?s).+"
    line = "" if any("\n" in p for p in ids) else r"\n"
    if any(re.search(rf"{LETTER}[,.]", p) for p in ids):
        return rf"{line or '(?!)'}| *[^ {line}]+| +"
    return rf"{line or '(?!)'}| *[^ ,.{line}]*{LETTER}(?=[,.])| *[^ {line}]+| +"


def merged(text: str, v: Vocabulary) -> tuple[list[str], tuple[str, str] | None]:
    """What merging makes of a short text, and what it merged last: the best scored neighbours, then the leftmost."""
    held, last = list(text), None
    while True:
        best, at = None, -1
        for k in range(len(held) - 1):
            i = v.ids.get(held[k] + held[k + 1])
            if i is not None and (best is None or v.scores[i] > best):
                best, at = v.scores[i], k
        if at < 0:
            return held, last
        last = (held[at], held[at + 1])
        held[at : at + 2] = [held[at] + held[at + 1]]


def is_whole(piece: str, v: Vocabulary) -> bool:
    """Whether merging makes the piece of its characters; notes the two parts it is made of."""
    if piece not in v.trees:
        held, last = merged(piece, v)
        v.trees[piece] = (last or ("", "")) if held == [piece] else None
    return v.trees[piece] is not None


def edge(piece: str, side: int, v: Vocabulary) -> list[tuple[str, float]] | None:
    """What stands at the right (1) or left (0) end of a piece while it is made, each with the score of the merge that
    ends it; none if a merge comes before one it needs."""
    if (piece, side) not in v.edges:
        out, at, until = [], piece, float("-inf")
        while out is not None:
            out.append((at, until))
            if len(at) == 1:
                break
            is_whole(at, v)
            parts, until = v.trees[at], v.scores[v.ids[at]]
            if parts is None or any(len(p) > 1 and v.scores[v.ids[p]] <= until for p in parts):
                out = None
            else:
                at = parts[side]
        v.edges[piece, side] = out
    return v.edges[piece, side]


def may_follow(a: str, b: str, v: Vocabulary) -> bool:
    """Whether merging leaves the two apart: nothing at their border is merged before one of its parts is gone."""
    left, right = edge(a, 1, v), edge(b, 0, v)
    if left is None or right is None:
        return merged(a + b, v)[0] == [a, b]
    ids, scores = v.ids, v.scores
    for x, x_until in left:
        for y, y_until in right:
            i = ids.get(x + y)
            if i is not None and scores[i] > x_until and scores[i] >= y_until:
                return False
    return True


def _ask(pair: int, v: Vocabulary, most: int = 300_000) -> bool:
    """``may_follow`` for two ids in one number, remembered."""
    a, b = divmod(pair, len(v.pieces))
    if len(v.follows) >= most:
        v.follows.clear()
    v.follows[pair] = found = may_follow(v.pieces[a], v.pieces[b], v)
    return found


def stream(text: str, v: Vocabulary) -> Iterator[list[int]]:
    """The ids of a text in which SPACE stands for a space and MARK for SPACE, in the order they are committed.

    Held are the boundaries since the last commit: ``before`` has the start and the id of the piece that survives
    at each of them. A character without a piece of its own is given in bytes; all paths meet before and behind it.
    """
    ids, tree, follows, size, longest, begin, end = v.ids, v.tree, v.follows, len(v.pieces), v.longest, 0, len(text)
    before: dict[int, tuple[int, int]] = {0: (-1, -1)}
    for at in range(end):
        if text[at] not in ids:
            yield path(before, begin, at)
            yield [v.byte_ids[b] for b in (SPACE if text[at] == MARK else text[at]).encode()]
            begin, before = at + 1, {at + 1: (-1, -1)}
            continue
        last = before[at][1]
        here, to = tree, at
        for c in text[at : at + longest]:
            if c not in here:
                break
            i, here = here[c]
            to += 1
            if i >= 0 and to not in before:  # longer pieces come first
                if last < 0:
                    before[to] = (at, i)
                else:
                    pair = last * size + i
                    fits = follows.get(pair)
                    if fits or (fits is None and _ask(pair, v)):
                        before[to] = (at, i)
        if at - begin >= 4 * longest:
            meet = common(before, at)
            if meet > begin:
                yield path(before, begin, meet)
                before = {k: x for k, x in before.items() if k >= meet}
                begin = meet
    yield path(before, begin, end)


UNKNOWN = np.float32(10)  # fixed value: how far a character without a piece lies below the worst score


def stream_by_score(text: str, v: Vocabulary) -> Iterator[list[int]]:
    """As ``stream``, for a unigram model. Sums are carried along the whole text as 32-bit numbers, as rounding them decides
    between paths of nearly equal score; between equal ones the longer last piece stays, which was found first."""
    tree, longest, begin, end = v.tree, v.longest, 0, len(text)
    scores = np.array(v.scores, np.float32)
    unknown = min((scores[k] for k in v.ids.values()), default=np.float32(0)) - UNKNOWN
    before: dict[int, tuple[int, int]] = {0: (-1, -1)}
    best = {0: np.float32(0)}

    def offer(to: int, at: int, i: int, score: np.float32) -> None:
        if to not in best or score > best[to]:
            before[to], best[to] = (at, i), score

    def spelled(upto: int) -> list[int]:
        """The ids of the survivor; a character without a piece is given in bytes."""
        out, at = [], begin
        for i in path(before, begin, upto):
            if i < 0:
                out += [v.byte_ids[b] for b in (SPACE if text[at] == MARK else text[at]).encode()]
            else:
                out.append(i)
            at += 1 if i < 0 else len(v.pieces[i])
        return out

    for at in range(end):
        total, here, to, alone = best.pop(at), tree, at, False
        for c in text[at : at + longest]:
            if c not in here:
                break
            i, here = here[c]
            to += 1
            if i >= 0:
                alone |= to == at + 1
                offer(to, at, i, total + scores[i])
        if not alone:
            offer(at + 1, at, -1, total + unknown)
        if at - begin >= 4 * longest:
            meet = common(before, at)
            if meet > begin:
                yield spelled(meet)
                before = {k: x for k, x in before.items() if k >= meet}
                begin = meet
    yield spelled(end)


def common(before: dict[int, tuple[int, int]], at: int) -> int:
    """The last boundary that every path runs through which passes ``at``."""
    live = {k for k in before if k >= at}
    while len(live) > 1:
        k = max(live)
        live.discard(k)
        live.add(before[k][0])
    return live.pop()


def path(before: dict[int, tuple[int, int]], begin: int, end: int) -> list[int]:
    """The ids of the survivor from ``begin`` to ``end``."""
    out = []
    while end > begin:
        end, i = before[end]
        out.append(i)
    return out[::-1]


class Known(dict):
    """The ids of parts as 32-bit numbers. Parts not seen before are encoded; short ones are kept, ``most`` twice: when
    the newer half is full it becomes the older one, from which parts that come again are taken back."""

    def __init__(self, v: Vocabulary, most: int = 400_000, short: int = 48) -> None:
        super().__init__()
        self.v, self.most, self.short, self.older = v, most, short, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            marked = part.replace(SPACE, MARK).replace(" ", SPACE)
            ids = array("i", chain.from_iterable(stream(marked, self.v))).tobytes()
            if len(part) > self.short:
                return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids


def encode_text(text: str, v: Vocabulary) -> bytes:
    """The ids of a text as 32-bit numbers. Parts that no path crosses are encoded alone in a merge model."""
    if v.kind == "unigram":
        marked = (" " + text).replace(SPACE, MARK).replace(" ", SPACE)
        return array("i", chain.from_iterable(stream_by_score(marked, v))).tobytes() if text else b""
    return b"".join(map(v.known.__getitem__, v.parts.findall(" " + text))) if text else b""


def decode_ids(ids: Sequence[int] | np.ndarray, v: Vocabulary) -> str:
    """The text of some ids; ids without a text, and those the vocabulary lacks, give nothing."""
    ids = np.asarray(ids, np.int64)
    ids = ids[(ids >= 0) & (ids < len(v.decoded))]
    text = b"".join(v.decoded[ids].tolist()).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _shared(docs: DataFrame, path: str):
    """The vocabulary for the tasks; each Python worker makes it once and keeps what it has learned of words."""
    v = load_vocabulary(path)
    plain = {"parts": (v.pieces, v.scores, v.byte_ids, v.idle, v.kind)}
    held = docs.sparkSession.sparkContext.broadcast(plain)

    def get() -> Vocabulary:
        if "made" not in held.value:
            held.value["made"] = Vocabulary(*held.value["parts"])
        return held.value["made"]

    return get


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the columns named in ``keep``, ids (array of int), n_ids and exact (decoding gives the text back).

    ``model`` is the path of a SentencePiece model with byte fallback, of the unigram or the merge kind; the driver reads it
    and refuses others. Every text is encoded
    whole, a space is put before it as the model asks, and what is held for it is bounded by the longest piece
    besides its own text and ids. A null text has null ids, n_ids 0 and a null exact; an empty one has no ids and
    is exact. Repeated rows are encoded alike; other columns do not matter.
    """
    vocabulary = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # some MB of ids at a time
                begin, parts, exact, held = at, [], [], 0
                while at < batch.num_rows and held < 1 << 23:
                    text = batch.column(0)[at].as_py()
                    ids = None if text is None else encode_text(text, v)
                    parts.append(ids)
                    exact.append(None if text is None else decode_ids(np.frombuffer(ids, np.int32), v) == text)
                    held += len(ids or b"")
                    at += 1
                sizes = np.array([len(p or b"") // 4 for p in parts])
                offsets = pa.array(
                    [*[None if p is None else int(o) for p, o in zip(parts, np.cumsum(sizes) - sizes)], int(sizes.sum())],
                    pa.int32(),
                )
                flat = pa.array(np.frombuffer(b"".join(p for p in parts if p), np.int32))
                made = [pa.ListArray.from_arrays(offsets, flat), pa.array(sizes, pa.int32()), pa.array(exact, pa.bool_())]
                rest = [batch.column(k + 1).slice(begin, at - begin) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=[*keep, "ids", "n_ids", "exact"])

    rows = docs.select(col(docs, "text"), *[col(docs, c) for c in keep])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kept}, ids array<int>, n_ids int, exact boolean")


def decode(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the columns named in ``keep`` and the text of its ids; null ids have a null text."""
    vocabulary = _shared(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        for batch in batches:
            found = batch.column(0)
            texts = [decode_ids(x, v) if (x := found[k].as_py()) is not None else None for k in range(batch.num_rows)]
            rest = [batch.column(k + 1) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], names=[*keep, "text"])

    rows = encoded.select(col(encoded, "ids"), *[col(encoded, c) for c in keep])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kept}, text string")
