"""Alignment of the tokens that two tokenizers make of the same text.

Both id lists are laid along the bytes of the text. A dictionary per side leads from the byte where a token ends to
the number of tokens up to there; the ends both dictionaries know, in order, cut the two lists into groups. Within a
group every token is linked with the tokens of the other side whose bytes it shares.

How often an id pair is linked in the whole corpus is counted from chunks: a task aligns some MB of texts, keeps per
document the links as numbers into the chunk's list of different pairs, and only that list is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import count
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual.llm.common import col, ship, stored

# The pattern by which byte-level vocabularies of this kind cut a text before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"  # stands for a space in pieces
LONG_BLANK = re.compile(r"\s{512}")  # the faster library does not stand long runs
ship(__name__)


@dataclass
class Encoder:
    """A vocabulary file, by its content: ``encode`` gives the ids of a text, ``entries`` the bytes of every id."""

    content: bytes
    kind: str  # "byte" (a JSON file of byte-level merges) or "piece" (a SentencePiece model)
    entries: list[bytes] = field(init=False, repr=False)
    sizes: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.entries = self._of_bytes() if self.kind == "byte" else self._of_pieces()
        self.sizes = np.array([len(e) for e in self.entries], np.int64)

    def _of_bytes(self) -> list[bytes]:
        import tokenizers

        given = json.loads(self.content)
        vocabulary, back = given["model"]["vocab"], {c: b for b, c in byte_letters().items()}
        self._library = tokenizers.Tokenizer.from_str(self.content.decode())
        self._library.encode_special_tokens = True
        special = {t["id"]: t["content"] for t in given["added_tokens"]}
        entries = [b""] * (1 + max([*vocabulary.values(), *special]))
        for piece, k in vocabulary.items():
            if k not in special:
                entries[k] = bytes(back[c] for c in piece)
        self._fast = _ranked(given, entries, special)
        return entries

    def _of_pieces(self) -> list[bytes]:
        import sentencepiece

        self._library = m = sentencepiece.SentencePieceProcessor(model_proto=self.content)
        pieces = [m.id_to_piece(k) for k in range(m.get_piece_size())]
        return [
            bytes([int(p[1:-1], 16)]) if m.is_byte(k) else b"" if m.is_control(k) or m.is_unknown(k) else p.replace(SPACE, " ").encode()
            for k, p in enumerate(pieces)
        ]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, the strings of special tokens taken as plain text. A byte vocabulary gets a space first."""
        if self.kind == "piece":
            return np.array(self._library.encode(text, num_threads=1), np.int64)
        text = " " + text
        if self._fast is not None and not LONG_BLANK.search(text):
            return self._fast.encode_to_numpy(text).astype(np.int64)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.int64)

    def gives(self, ids: np.ndarray, whole: bytes) -> bool:
        """Whether the ids' bytes are these. Merging bytes never changes them, so a byte vocabulary only has to end in time."""
        if self.kind == "byte" and self._fast is not None:
            return int(self.sizes[ids].sum()) == len(whole)
        return b"".join(picked(self.entries, ids.tolist())) == whole


def picked(held: list | dict, keys: list[int]) -> tuple:
    """What stands under each of the keys."""
    return itemgetter(*keys, keys[0])(held)[:-1] if keys else ()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, the others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = count(0x100)
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


def _ranked(given: dict, entries: list[bytes], special: dict[int, str]):
    """The same vocabulary in a faster library, if its ids are the order of its merges and nothing else is set."""
    model, cut = given["model"], given["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    extra = given["normalizer"] or any(model.get(x) for x in ("dropout", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix"))
    merges = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
    ordered = [model["vocab"].get(m.replace(" ", "")) for m in merges] == list(range(256, 256 + len(merges)))
    if not plain or extra or not ordered:
        return None
    import tiktoken

    ranks = {e: k for k, e in enumerate(entries) if e and k not in special}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Aligned:
    """How two id lists lie on each other: after how many ids each group ends, and the linked places of both."""

    cuts_a: np.ndarray
    cuts_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align_ends(ends_a: Sequence[int], ends_b: Sequence[int]) -> Aligned:
    """Groups and links of two ascending lists of ends; both must end at the same place, if anywhere."""
    known_a, known_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
    shared = list(filter(known_b.__contains__, known_a))  # in order, as dictionaries keep the order they were filled in
    cuts_a, cuts_b = (np.fromiter(map(k.__getitem__, shared), np.int64, len(shared)) for k in (known_a, known_b))
    size_a, size_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    from_a, from_b = cuts_a - size_a, cuts_b - size_b
    links = size_a + size_b - 1  # no two ends inside a group are equal
    at = np.cumsum(links) - links
    step = np.arange(int(links.sum())) - np.repeat(at, links)  # a side of one token keeps it, the other goes on
    link_a = np.repeat(from_a, links) + np.minimum(step, np.repeat(size_a - 1, links))
    link_b = np.repeat(from_b, links) + np.minimum(step, np.repeat(size_b - 1, links))
    both = (size_a > 1) & (size_b > 1)
    for i, j, last_a, last_b, k in zip(*(x[both].tolist() for x in (from_a, from_b, cuts_a - 1, cuts_b - 1, at))):
        while i < last_a or j < last_b:
            if ends_a[i] < ends_b[j]:
                i += 1
            else:
                j += 1
            k += 1
            link_a[k], link_b[k] = i, j
    return Aligned(cuts_a, cuts_b, link_a, link_b)


def align_text(text: str | None, a: Encoder, b: Encoder) -> tuple[np.ndarray, np.ndarray, Aligned] | None:
    """Ids and alignment of a text; nothing if it is null or empty or either side does not give its bytes back."""
    if not text:
        return None
    whole = b" " + text.encode()
    ids_a, ids_b = a.encode(text), b.encode(text)
    if not a.gives(ids_a, whole) or not b.gives(ids_b, whole):
        return None
    return ids_a, ids_b, align_ends(np.cumsum(a.sizes[ids_a]).tolist(), np.cumsum(b.sizes[ids_b]).tolist())


class Writer:
    """Spells groups as ``a1,a2|b1;a3|b2,b3``. Each id of a and then of b has a word with a comma behind it, and, further down,
    one with what ends its side of a group."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.n_a, self.n = n_a, n_a + n_b
        words = [b"%d%c" % (k, c) for ends in ((b",", b","), (b"|", b";")) for n, c in zip((n_a, n_b), ends) for k in range(n)]
        width = max([8, *map(len, words)])
        self.words = np.array(words, f"S{width}")  # filled up with zero bytes
        if width == 8:
            self.words = self.words.view(np.uint64)  # picked faster

    def spell(self, ids_a: np.ndarray, ids_b: np.ndarray, aligned: Aligned, at_once: int = 1 << 16) -> Iterator[bytes]:
        cuts_a, cuts_b = aligned.cuts_a, aligned.cuts_b
        sizes_a, sizes_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        place_a = np.arange(len(ids_a)) + np.repeat(cuts_b - sizes_b, sizes_a)
        place_b = np.arange(len(ids_b)) + np.repeat(cuts_a, sizes_b)
        rows = np.empty(len(ids_a) + len(ids_b), np.int64)
        rows[place_a], rows[place_b] = ids_a, ids_b + self.n_a
        rows[place_a[cuts_a - 1]] += self.n
        rows[place_b[cuts_b - 1]] += self.n
        for at in range(0, len(rows), at_once):
            text = self.words[rows[at : at + at_once]].tobytes().translate(None, b"\0")
            yield text if at + at_once < len(rows) else text[:-1]

    def digest(self, ids_a: np.ndarray, ids_b: np.ndarray, aligned: Aligned) -> str:
        held = hashlib.sha256()
        for text in self.spell(ids_a, ids_b, aligned):
            held.update(text)
        return held.hexdigest()


def _shared(docs: DataFrame, a: str, b: str):
    """Both encoders for the tasks, from the files' content; each Python worker makes them once. Both sizes are those of
    vocabulary files, whatever the corpus."""
    content = {"a": Path(a).read_bytes(), "b": Path(b).read_bytes(), "kinds": [_kind(a), _kind(b)]}
    held = docs.sparkSession.sparkContext.broadcast(content)

    def get() -> tuple[Encoder, Encoder, Writer]:
        x = held.value
        if "made" not in x:
            made = Encoder(x["a"], x["kinds"][0]), Encoder(x["b"], x["kinds"][1])
            x["made"] = *made, Writer(len(made[0].entries), len(made[1].entries))
        return x["made"]

    return get, [len(Encoder(content[side], kind).entries) for side, kind in zip("ab", content["kinds"])]


def _kind(path: str) -> str:
    return "byte" if path.endswith(".json") else "piece"


def align(docs: DataFrame, a: str, b: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in ``keep``, a_ids, b_ids, and groups: of each its place in the bytes of space and text
    (``start``, ``end``) and the places of its ids in both lists (``a_from``, ``a_to``, ``b_from``, ``b_to``, ends excluded).

    ``a`` and ``b`` are paths of vocabulary files, which the driver reads: byte-level merges in JSON or SentencePiece
    models. Texts that are null or empty, or whose tokens do not give space and text back, have empty lists. Repeated
    rows are aligned alike, and an empty table gives an empty result; further columns do not matter.
    """
    get, _ = _shared(docs, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_a, encoder_b, _ = get()
        for batch in batches:
            for at in range(batch.num_rows):  # a row at a time: a very long text stays alone
                found = align_text(batch.column(0)[at].as_py(), encoder_a, encoder_b)
                ids_a, ids_b, groups = found or ([], [], None)
                spans = []
                if groups:
                    ends = np.cumsum(encoder_a.sizes[ids_a])[groups.cuts_a - 1].tolist()
                    cuts = [[0, *x.tolist()] for x in (groups.cuts_a, groups.cuts_b)]
                    fields = zip([0, *ends], ends, cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])
                    spans = [dict(zip(("start", "end", "a_from", "a_to", "b_from", "b_to"), f)) for f in fields]
                rest = [batch.column(k + 1).slice(at, 1) for k in range(len(keep))]
                made = [pa.array([ids_a], pa.list_(pa.int32())), pa.array([ids_b], pa.list_(pa.int32())), pa.array([spans], _SPANS)]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=[*keep, "a_ids", "b_ids", "groups"])

    rows = docs.select(col(docs, "text"), *[col(docs, c) for c in keep])
    span = "struct<start:int,end:int,a_from:int,a_to:int,b_from:int,b_to:int>"
    return rows.mapInArrow(run, f"{_kept(rows)}, a_ids array<int>, b_ids array<int>, groups array<{span}>")


_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "a_from", "a_to", "b_from", "b_to")]))


def _kept(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])


_FOUND = ["n_a", "n_b", "n_groups", "n_links"]


def _chunks(docs: DataFrame, a: str, b: str, keep: tuple[str, ...], chunk_bytes: int) -> tuple[DataFrame, int]:
    """Rows of some documents each: chunk, body (an Arrow table with a row per document: what is kept, the counts and
    the digest, and its different links as places in the chunk's list, with their number), pair and times (that list:
    a's id times b's vocabulary plus b's id, and how often it is linked); and the size of b's vocabulary."""
    get, (_, size_b) = _shared(docs, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder_a, encoder_b, writer = get()
        chunk, part = count(), TaskContext.get().partitionId() << 33
        held, kept, size = [], [], 0

        def flush() -> pa.RecordBatch:
            pair, place = np.unique(np.concatenate([h[5] for h in held]), return_inverse=True)
            times = np.concatenate([h[6] for h in held])
            total = np.bincount(place, times, len(pair)).astype(np.int64)
            offsets = pa.array(np.cumsum([0, *[len(h[5]) for h in held]]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (place, times)]
            counts = [pa.array([h[k] for h in held], pa.int64()) for k in range(4)]
            rest = [pa.concat_arrays([x[k] for x in kept]) for k in range(len(keep))]
            columns = [*rest, *counts, pa.array([h[4] for h in held], pa.string()), *lists]
            body = pa.RecordBatch.from_arrays(columns, names=[*map(str, range(len(keep))), *_FOUND, "groups_sha256", "place", "times"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(body)
            one = [pa.array([part + next(chunk)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (pair, total)]
            return pa.RecordBatch.from_arrays([*one, *lists], names=["chunk", "body", "pair", "times"])

        none = np.empty(0, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(0)[at].as_py()
                found = align_text(text, encoder_a, encoder_b)
                if found:
                    ids_a, ids_b, aligned = found
                    codes = ids_a[aligned.link_a] * size_b + ids_b[aligned.link_b]
                    digest = writer.digest(ids_a, ids_b, aligned)
                    held.append((len(ids_a), len(ids_b), len(aligned.cuts_a), len(codes), digest, *np.unique(codes, return_counts=True)))
                else:
                    held.append((0, 0, 0, 0, "", none, none))
                kept.append([batch.column(k + 1).slice(at, 1) for k in range(len(keep))])
                size += len(text or "")
                if size >= chunk_bytes or len(held) >= chunk_bytes >> 6:
                    yield flush()
                    held, kept, size = [], [], 0
        if held:
            yield flush()

    rows = docs.select(col(docs, "text"), *[col(docs, c) for c in keep])
    return rows.mapInArrow(run, "chunk long, body binary, pair array<long>, times array<long>"), size_b


def pair_counts(chunks: DataFrame, size_b: int) -> DataFrame:
    """pair, n (links in the corpus) and best (no other pair with the same id of b has more) of every linked id pair."""
    listed = chunks.select(F.explode(F.arrays_zip("pair", "times")).alias("x"))
    counts = listed.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = stored(counts.withColumn("b", F.col("pair") % size_b), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of b at most
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_counts(
    docs: DataFrame, a: str, b: str, keep: tuple[str, ...] = ("doc_id",), chunk_bytes: int = 4 << 20
) -> DataFrame:
    """The columns named in ``keep``; n_a, n_b, n_groups, n_links; n_best (links whose id pair is linked in the corpus as
    often as any pair with that id of ``b``), count_sum (over links, of the links in the corpus of their id pair); and
    groups_sha256 of the ids by group, as text. Files, nulls, repeated rows and empty tables as in ``align``.

    A chunk holds ``chunk_bytes`` characters, or one text that is longer. Chunks are stored, so no text is encoded twice;
    what is shuffled are the different pairs of each chunk, twice, and the documents' links packed as places of pairs.
    """
    made, size_b = _chunks(docs, a, b, keep, chunk_bytes)
    chunks = stored(made, "aligned")
    listed = chunks.select("chunk", F.posexplode("pair").alias("place", "pair"))
    known = listed.join(pair_counts(chunks, size_b), "pair")
    # As long as the chunk has different pairs, which its bytes bound.
    packed = F.struct("place", F.col("n"), "best")
    lists = known.groupBy("chunk").agg(F.collect_list(packed).alias("known"))
    rows = chunks.select("chunk", "body").join(lists, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                body = pa.ipc.open_stream(batch.column("body")[at].as_py()).read_next_batch()
                found = batch.column("known").slice(at, 1).flatten()
                place = found.field("place").to_numpy()
                n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                n[place], best[place] = found.field("n").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
                links = body.column("place")
                used, times = links.flatten().to_numpy(), body.column("times").flatten().to_numpy().astype(np.int64)
                upto = links.offsets.to_numpy()
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[used] * times)])[upto]) for x in (best, n)]
                rest = [body.column(k) for k in range(len(keep))]
                counts = [body.column(c) for c in _FOUND]
                columns = [*rest, *counts, *map(pa.array, sums), body.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *_FOUND, "n_best", "count_sum", "groups_sha256"])

    kept = _kept(docs.select(col(docs, "text"), *[col(docs, c) for c in keep]))
    longs = ", ".join(f"{c} long" for c in (*_FOUND, "n_best", "count_sum"))
    return rows.select("body", "known").mapInArrow(run, f"{kept}, {longs}, groups_sha256 string")
