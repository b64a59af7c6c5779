"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled texts. Features of a text are densities of lexicon
words, how near they stand to the second person, and rates of capitals, punctuation and obfuscation. The trees and the
calibration are Spark's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaqual.llm.common import only, ship, stored

# Pronouns of the second person in English, German, French and Spanish.
SECOND_PERSON = """you your yours yourself yourselves du dich dir dein deine deinen deinem deiner ihr euch euer eure
tu te toi ton ta tes vous votre vos ti tuyo tuya usted ustedes vosotros os su""".split()
# Characters that stand for letters in obfuscated words.
LOOKS_LIKE = str.maketrans("013457@$!+", "oieastasit")

FEATURES = [
    "hits", "hit_density", "best_weight", "weight_density", "hit_sentences", "near_you", "you_density", "hidden_hits",
    "capitals", "shouted_words", "exclaims", "questions", "repeated_marks", "marks", "obfuscated", "stretched", "words",
    "word_length",
]
BEGINNINGS = (4, 5, 6)
YOU, SHOUT, ODD, STRETCH, HIDDEN, WEIGHT = 1, 2, 4, 8, 16, 5  # flags of a word; its weight is in the bits from WEIGHT on
ship(__name__)


@dataclass
class Toxicity:
    """What ``learn_toxicity`` has fitted; without two classes to learn from only the rate ``base``."""

    lexicon: dict[str, int]  # words and, with a star, beginnings of words -> weight in hundredths
    base: float
    trees: PipelineModel | None = None
    calibration: object = None


def terms(text: Column) -> Column:
    """The different words of a text in lower case, without marks at their ends, and their beginnings with a star."""
    words = F.array_distinct(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " ")), " "))
    stars = [_beginnings(words, n) for n in BEGINNINGS]
    return F.array_distinct(F.filter(F.concat(words, *stars), lambda w: F.length(w) > 1))


def _beginnings(words: Column, n: int) -> Column:
    long = F.filter(words, lambda w: F.length(w) > n)
    return F.transform(long, lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def learn_lexicon(sample: DataFrame, most: int, least_docs: int = 5) -> dict[str, int]:
    """The ``most`` terms whose documents are most clearly toxic; ``sample`` has text and toxic (0 or 1).

    A term's weight is the logarithm of the odds of its documents against all others, smoothed; it needs
    ``least_docs`` toxic documents and a weight of 2 at least. Terms that a shorter beginning covers as well are left out.
    """
    bad, good = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not bad or not good:
        return {}
    counts = sample.select("toxic", F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    odds = lambda c, n: (F.col(c) + 0.5) / (F.lit(n) - F.col(c) + 0.5)
    weight = F.log(odds("bad", bad) / odds("good", good))
    rows = counts.filter(F.col("bad") >= least_docs).withColumn("weight", weight).filter("weight >= 2")
    found = rows.orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "term").limit(most).collect()
    by_term = {r["term"]: r["weight"] for r in found}
    out = {}
    for term, w in by_term.items():
        body = term.rstrip("*")
        shorter = [by_term.get(f"{body[:n]}*", 0) for n in BEGINNINGS if n < len(body)]
        if all(w > s + 0.5 for s in shorter if s):
            out[term] = round(100 * w)
    return out


class Words(dict):
    """The flags and weight of a word, as one number; words not seen before are looked at and kept, within bounds."""

    def __init__(self, lexicon: dict[str, int], most: int = 200_000) -> None:
        super().__init__()
        self.lexicon, self.most, self.you = lexicon, most, frozenset(SECOND_PERSON)

    def weight(self, word: str) -> int:
        look = self.lexicon.get
        return max(look(word, 0), *(look(f"{word[:n]}*", 0) for n in BEGINNINGS if n < len(word)), 0)

    def __missing__(self, raw: str) -> int:
        word = raw.strip(".,;:!?\"'()[]{}«»„“”…-–—*_")
        low = word.lower()
        odd = bool(re.search(r"[^\W\d_][\d@$!*+_.]+[^\W\d_]|^[@$][^\W\d_]", word)) and "://" not in raw
        stretched = bool(re.search(r"([^\W\d_])\1\1", low))
        code, weight = 0, self.weight(low)
        if not weight and (odd or stretched):
            clear = re.sub(r"[\W\d_]", "", low.translate(LOOKS_LIKE))
            weight = max(self.weight(clear), self.weight(re.sub(r"(.)\1+", r"\1", clear)))
            code |= HIDDEN * (weight > 0)
        code |= YOU * (low in self.you) | ODD * odd | STRETCH * stretched
        code |= SHOUT * (len(word) > 2 and word.isupper()) | weight << WEIGHT
        if len(self) >= self.most:
            self.clear()
        self[raw] = code
        return code


def features(text: str | None, known: Words) -> list[float]:
    """The numbers of FEATURES for one text, all 0 for one without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, raw = len(words), text.encode("utf-8", "replace")
    codes = np.fromiter(map(known.__getitem__, words), np.int64, n)
    weight = codes >> WEIGHT
    hit = np.flatnonzero(weight)
    you = np.flatnonzero(codes & YOU)
    near = 0.0
    if len(hit) and len(you):
        place = np.searchsorted(you, hit)
        before, after = you[np.maximum(place - 1, 0)], you[np.minimum(place, len(you) - 1)]
        near = float((1 / (1 + np.minimum(np.abs(hit - before), np.abs(after - hit)))).max())
    letters = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(letters, minlength=256)
    small, large = int(kinds[97:123].sum()), int(kinds[65:91].sum())
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    twice = (letters[1:] == letters[:-1]) & ((letters[1:] == 33) | (letters[1:] == 63))
    share = lambda flag: float(np.count_nonzero(codes & flag)) / n
    return [
        float(len(hit)), len(hit) / n, float(weight.max()) / 100, float(weight.sum()) / 100 / n,
        float(len(np.unique(hit // 20))), near, len(you) / n, float(np.count_nonzero(codes & HIDDEN)),
        large / max(small + large, 1), share(SHOUT), int(kinds[33]) / n, int(kinds[63]) / n,
        float(np.count_nonzero(twice)) / n, marks / max(len(raw), 1), share(ODD), share(STRETCH), float(np.log1p(n)),
        len(text) / n,
    ]


def text_features(docs: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """doc_id, h (hash of the text) and FEATURES of every row; the whole text counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(lexicon)
        for batch in batches:
            texts = batch.column(2)
            made = np.array([features(texts[k].as_py(), known) for k in range(batch.num_rows)], np.float64)
            columns = [pa.array(c) for c in made.reshape(batch.num_rows, len(FEATURES)).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "h", *FEATURES])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, " + ", ".join(f"{c} double" for c in FEATURES))


def _sample(labels: DataFrame, usable: Column, most: int) -> DataFrame:
    """doc_id and toxic of the labelled rows with the smallest hash, ``most`` at most; a label of 1 wins over one of 0."""
    rows = only(labels, "doc_id", "toxic").filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("id"), "toxic")


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column, lexicon_rows: int = 12_000, lexicon_terms: int = 400,
    fit_rows: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 5,
) -> Toxicity:
    """Fit on bounded samples of the labelled rows that ``usable``, on doc_id, allows.

    The lexicon is learned from ``lexicon_rows`` documents, the trees from three quarters and the calibration from one
    quarter of ``fit_rows``, chosen by hash. Without labels of both kinds only their rate is learned, 0 for no labels.
    """
    sample = stored(_sample(labels, usable, max(lexicon_rows, fit_rows)), "labelled")
    first = sample.orderBy(F.xxhash64("id"), "id").limit(lexicon_rows)
    of = only(docs, "doc_id", "text").filter("text is not null")
    texts = of.join(F.broadcast(first), of["doc_id"].cast("long") == F.col("id"))
    lexicon = learn_lexicon(stored(texts.select("toxic", "text"), "lexicon-texts"), lexicon_terms)
    chosen = sample.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    mine = only(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("id"))
    labelled = stored(text_features(mine, lexicon).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")), "fit")
    rows, bad = labelled.agg(F.count("*"), F.sum("toxic")).first()
    if not bad or bad == rows:
        return Toxicity(lexicon, float(bad or 0) / rows if rows else 0.0)
    quarter = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4))
    label = F.col("toxic").cast("double").alias("label")
    fit = labelled.filter(quarter != 0).select(*FEATURES, label)
    check = labelled.filter(quarter == 0)
    if fit.select("label").distinct().count() < 2:
        fit = check = labelled.select("*", label)
    boosted = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, minInstancesPerNode=5
    ).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(fit))
    model = PipelineModel([VectorAssembler(inputCols=FEATURES, outputCol="features"), boosted])
    margin = vector_to_array("rawPrediction")[1]
    seen = model.transform(check.select(*FEATURES, label)).select(margin.alias("margin"), "label")
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(stored(seen, "margins"))
    return Toxicity(lexicon, float(bad) / rows, model, steps)


def score_toxicity(docs: DataFrame, model: Toxicity, least: float = 0.7) -> DataFrame:
    """doc_id, h (hash of the text), score (0 to 1) and predicted (1 from a score of ``least`` on) of every row.

    The score is the calibrated probability of the toxic label. Null, empty and blank texts have features of 0 and are
    scored like any other text; repeated rows are scored alike; other columns do not matter.
    """
    made = text_features(docs, model.lexicon)
    if model.trees is None:
        scored = made.select("doc_id", "h", F.lit(model.base).alias("score"))
    else:
        margin = vector_to_array("rawPrediction")[1].alias("margin")
        raw = model.trees.transform(made).select("doc_id", "h", margin)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score")
        scored = model.calibration.transform(raw).select("doc_id", "h", score)
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def drop_toxic(docs: DataFrame, model: Toxicity, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is under ``least``, unchanged. Rows of equal id and text go or stay together."""
    bad = score_toxicity(docs, model, least).filter("predicted = 1").select("doc_id", "h").distinct().toDF("__id", "__h")
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h"))
    return keyed.join(bad, same, "left_anti").drop("__text")
