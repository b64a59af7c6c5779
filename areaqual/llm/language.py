"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built of labelled sample text. A text is parsed against each automaton
into phrases: the longest stretch that occurs in the sample, then the next one. The number of phrases times the
bits it takes to point into the sample, divided by the length of the text, estimates the cross entropy; the
language that needs least wins.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaqual.llm.common import only, ship

GAP, OTHER = 0, 1  # anything but letters; letters that no sample has
UNKNOWN = "und"
ship(__name__)


@dataclass
class Phrases:
    """The automata of all languages as one table; see ``automata``."""

    languages: list[str]
    symbols: np.ndarray  # symbol of each code point
    width: int  # symbols with a column in steps; the others are rare
    steps: np.ndarray  # [state * width + symbol] -> next state * width << 2 | phrases that end
    rare_at: np.ndarray  # sorted: state * width * rare symbols + symbol - width
    rare_to: np.ndarray  # next state * width << 2, for each of rare_at
    rare_start: np.ndarray  # [language, symbol - width] -> the same from the root, or -1
    roots: np.ndarray
    bits: np.ndarray  # of a phrase, for each language


def learn_languages(
    docs: DataFrame, usable: Column, rows_per_language: int = 48, symbols_per_language: int = 32_768, max_letters: int = 62
) -> Phrases:
    """Fit on a bounded sample: of each language the rows with the smallest hash of ``doc_id``.

    ``usable`` marks the rows that may be learned from; rows without lang or text are not. At most
    ``rows_per_language`` rows of a language reach the driver, of each no more than ``symbols_per_language``
    characters, and so many symbols in all enter its automaton. Every letter of the samples has a symbol of its own;
    those of the ``max_letters`` most frequent ones are looked up in a table, the others by search.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        rows.select("lang", "doc_id").withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= rows_per_language).select("lang", "doc_id", "place")
    )
    text = F.substring("text", 1, symbols_per_language)
    sample = rows.join(F.broadcast(ids), ["lang", "doc_id"]).select("lang", "place", "doc_id", text.alias("text")).distinct()
    texts: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["place"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return automata(texts, symbols_per_language, max_letters)


def automata(texts: dict[str, list[str]], most: int, max_letters: int) -> Phrases:
    """One transition table for all languages. A missing transition ends the phrase and starts the next at the root."""
    count: Counter[str] = Counter()
    for parts in texts.values():
        for part in parts:
            for c, n in Counter(part).items():
                if c.isalpha():
                    count[small(c)] += n
    letters = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
    symbols, width, rare = symbol_table(letters), min(len(letters), max_letters) + 2, max(len(letters) - max_letters, 0)
    languages, tables, bits, base = sorted(texts), [], [], 0
    roots = np.zeros(len(languages), np.int64)
    rare_at, rare_to, rare_start = [], [], np.full((len(languages), rare), -1, np.int64)
    for k, name in enumerate(languages):
        sequence = np.concatenate([symbols_of(p, symbols) for p in texts[name]] or [np.zeros(0, np.uint8)])[:most]
        go = suffix_automaton(sequence.tolist())
        table = dense(go, width)
        roots[k] = base * width
        tables.append(followed(table, base, width))
        bits.append(np.log2(len(sequence) + 2))
        for state, to in enumerate(go):
            for symbol, then in to.items():
                if symbol >= width:
                    rare_at.append((state + base) * width * rare + symbol - width)
                    rare_to.append((then + base) * width << 2)
                    if not state:
                        rare_start[k, symbol - width] = rare_to[-1]
        base += len(table)
    steps = np.concatenate(tables) if tables else np.zeros(0, np.int64)
    order = np.argsort(np.array(rare_at, np.int64))
    found = np.array(rare_at, np.int64)[order], np.array(rare_to, np.int32)[order], rare_start.astype(np.int32)
    return Phrases(languages, symbols, width, steps.astype(np.int32), *found, roots, np.array(bits))


def small(c: str) -> str:
    """One small letter for each letter, whatever stands beside it."""
    return c.lower()[0]


def symbol_table(letters: list[str]) -> np.ndarray:
    """The symbol of every code point; capitals share that of their small letter."""
    own = {c: k + 2 for k, c in enumerate(letters)}
    table = np.zeros(sys.maxunicode + 1, np.min_scalar_type(len(letters) + 1))
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            table[point] = own.get(small(c), OTHER)
    return table


def symbols_of(text: str, table: np.ndarray) -> np.ndarray:
    """The symbols of a text with a gap at its end; of neighbouring gaps one stays."""
    points = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    found = table[points]
    return found[(found != GAP) | (np.concatenate([[OTHER], found[:-1]]) != GAP)]


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every stretch of the sequence; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in sequence:
        new = len(go)
        go.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in go[at]:
            go[at][c] = new
            at = link[at]
        if at >= 0:
            to = go[at][c]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                split = len(go)
                go.append(dict(go[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                while at >= 0 and go[at].get(c) == to:
                    go[at][c] = split
                    at = link[at]
                link[to] = link[new] = split
        last = new
    return go


def dense(go: list[dict[int, int]], width: int) -> np.ndarray:
    table = np.full((len(go), width), -1, np.int64)
    for state, to in enumerate(go):
        for symbol, then in to.items():
            if symbol < width:
                table[state, symbol] = then
    return table


def followed(table: np.ndarray, base: int, width: int) -> np.ndarray:
    """Where each symbol leads, with the number of phrases it ends in the two lowest bits."""
    ends = (table < 0).astype(np.int64)
    start = np.where(table[0] >= 0, table[0], 0)
    ends[1:] += ends[1:] * (table[0] < 0)  # a symbol the sample lacks is a phrase of its own
    to = np.where(table >= 0, table, start[None, :])
    return (((to + base) * width) << 2 | ends).ravel()


def follow_rare(to: np.ndarray, state: np.ndarray, symbol: np.ndarray, model: Phrases) -> None:
    """Put into ``to`` where the rare symbols lead; it holds what holds for languages that lack them."""
    places = np.flatnonzero(symbol >= model.width)
    if not len(places):
        return
    column = symbol[places].astype(np.int64) - model.width
    language, k = np.nonzero(model.rare_start[:, column] >= 0)
    key = state[language, places[k]].astype(np.int64) * model.rare_start.shape[1] + column[k]
    at = np.minimum(np.searchsorted(model.rare_at, key), len(model.rare_at) - 1)
    start = model.rare_start[language, column[k]]
    to[language, places[k]] = np.where(model.rare_at[at] == key, model.rare_to[at], start | 1)


def phrase_counts(
    texts: list[str], model: Phrases, window: int, longest: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of every text in every language, symbols and whether there is a letter; all windows advance together."""
    parts = [symbols_of(t, model.symbols) for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    stream = np.concatenate(parts)
    rare = bool(len(model.rare_at)) and bool((stream >= model.width).any())
    columns = np.where(stream < model.width, stream, OTHER) if rare else stream
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pieces = -(-lengths // window)
    owner = np.repeat(np.arange(len(texts)), pieces)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[owner] + step * window
    size = np.minimum(lengths[owner] - step * window, window)
    order = np.argsort(-size, kind="stable")
    owner, start, size = owner[order], start[order], size[order]
    roots = model.roots.astype(np.int32)[:, None]
    state = np.repeat(roots, len(owner), axis=1)
    count = np.zeros(state.shape, np.int32)
    held = np.zeros(state.shape, np.int16)  # symbols in the present phrase
    live = np.searchsorted(-size, -np.arange(window), side="left")  # pieces longer than t
    for t in range(int(size[0]) if len(size) else 0):
        k = live[t]
        at = state[:, :k] + columns[start[:k] + t].astype(np.int32)
        to = model.steps.take(at)
        if rare:
            follow_rare(to, state, stream[start[:k] + t], model)
        ends = to & 3
        held[:, :k] = run = np.where(ends, 0, held[:, :k]) + 1
        full = run >= longest
        count[:, :k] += ends + full
        state[:, :k] = np.where(full, roots, to >> 2)
        held[:, :k][full] = 0
    count += state != roots
    total = np.zeros((len(model.languages), len(texts)), np.int64)
    for k in range(len(model.languages)):
        total[k] = np.bincount(owner, weights=count[k], minlength=len(texts))
    letters = np.array([bool((p != GAP).any()) for p in parts], bool)
    return total, lengths, letters


def judge(texts: list[str | None], model: Phrases, window: int, longest: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a symbol of each text."""
    counts, lengths, letters = phrase_counts([t or "" for t in texts], model, window, longest)
    cost = counts * model.bits[:, None]  # bits in all
    best = cost.argmin(axis=0)
    chance = 1 / np.exp2(np.clip(cost.min(axis=0)[None, :] - cost, -1000, 0)).sum(axis=0)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, chance, 0.0), np.where(letters, cost.min(axis=0) / np.maximum(lengths, 1), 0.0)


def identify_language(
    docs: DataFrame, model: Phrases, window: int = 4096, longest: int = 12, at_once: int = 4_000_000
) -> DataFrame:
    """Adds lang_pred, score and bits to every row's doc_id; one row for each row of ``docs``.

    The whole text counts, whatever its length: it is parsed in windows of ``window`` symbols, so a phrase also ends
    at the border of a window. A phrase has ``longest`` symbols at most, so that a passage copied from a sample tells
    no more than other text. About ``at_once`` characters are in memory at a time, or one text. ``score`` is the
    probability of the winner if all languages were equally likely and the parses were codes. A text that is null or
    has no letter is ``und`` with score 0, as is every text if nothing was learned. Ties go to the first language by
    name. Other columns do not matter; repeated rows are scored alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                texts, held, begin = [], 0, at
                while at < batch.num_rows and (not texts or held < at_once):
                    texts.append(column[at].as_py())
                    held += len(texts[-1] or "")
                    at += 1
                if model.languages:
                    names, score, bits = judge(texts, model, window, longest)
                else:
                    names, score, bits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, at - begin), pa.array(names, pa.string()), pa.array(score), pa.array(bits)],
                    names=["doc_id", "lang_pred", "score", "bits"],
                )

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")
