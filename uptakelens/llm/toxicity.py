"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: how densely it holds words of a learned lexicon (also those spelled with
digits or signs in place of letters), how near second-person words stand to them, and its rates of
capitals, punctuation and obfuscation. They come from the bytes of a batch of texts at once, inside
the tasks, without a shuffle.

The lexicon holds the words that occur at least MIN_COUNT times as often in toxic as in other
texts of the training rows; trees are fitted on one part of these rows, the calibration on the
rest. Training reads at most about TRAIN_ROWS labelled rows, chosen by the hash of their id, and
keeps at most LEXICON words, so its cost doesn't grow with the corpus. Scores are 0 to 1.

Null and empty texts have all features zero and get the score the model gives them. Rows without
a label, or with a null one, teach nothing; without both classes the score is the share of toxic
rows (0 without any). Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uptakelens.llm import ragged
from uptakelens.llm.tables import settled, training_fold

#: Most labelled rows used for training, about; one in FOLDS calibrates.
TRAIN_ROWS = 16_000
FOLDS = 4
#: Words of the lexicon: how many at most, in how many toxic texts at least, how much commoner there.
LEXICON = 400
MIN_COUNT = 5
MIN_RATIO = 4.0
THRESHOLD = 0.3
#: Tokens within which a second-person word counts as near.
REACH = 4
SECOND_PERSON = (
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
    "ihr euch euer sie ihnen usted ustedes ti tus su vosotros os"
).split()
#: Signs and digits written for letters.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = [
    "lexicon_rate", "lexicon_hits", "strongest", "weight_rate", "disguised_hits", "person_near",
    "person_rate", "capital_rate", "capital_word_rate", "punctuation_rate", "exclamation_rate",
    "question_rate", "sign_rate", "digit_rate", "repeat_rate", "mixed_word_rate", "words",
]

_DISGUISE = np.arange(256, dtype=np.uint8)
for _a, _b in DISGUISES.items():
    _DISGUISE[ord(_a)] = ord(_b)


def hashes_of(words: list[str]) -> np.ndarray:
    """The hash that a word has inside a text."""
    data, at = ragged.utf8(pa.array(words, pa.string()))
    return ragged.span_hashes(ragged.lowered(data), at[:-1], at[1:])


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes of the words and their weights (how much commoner they are), 0 to 1."""

    hashes: np.ndarray
    weights: np.ndarray

    def weigh(self, words: np.ndarray) -> np.ndarray:
        """Weight of each word, 0 for the others."""
        if not len(self.hashes):
            return np.zeros(len(words))
        place = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[place] == words, self.weights[place], 0.0)


def lexicon_of(words: list[str], weights: list[float]) -> Lexicon:
    hashes, first = np.unique(hashes_of(words), return_index=True)
    return Lexicon(hashes, np.asarray(weights, float)[first])


_PERSONS = np.sort(hashes_of(SECOND_PERSON))


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per text."""
    data, at = ragged.utf8(column)
    n, size = len(at) - 1, np.maximum(np.diff(at), 1)
    text_of = np.repeat(np.arange(n), np.diff(at))

    def rate(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[mask], minlength=n) / size

    upper = (data >= 65) & (data <= 90)
    lower = ragged.lowered(data)
    letter = ((lower >= 97) & (lower <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    sign = np.isin(data, np.frombuffer(b"#$%&*@^~_|<>+=", np.uint8))
    mark = np.isin(data, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    repeat = np.zeros(len(data), bool)
    repeat[2:] = letter[2:] & (lower[2:] == lower[1:-1]) & (lower[2:] == lower[:-2])

    plain_begin, plain_end = ragged.words(lower, at, ~letter)
    plain = ragged.span_hashes(lower, plain_begin, plain_end)
    weight = lexicon.weigh(plain)
    text = np.searchsorted(at, plain_begin, "right") - 1
    count = np.bincount(text, minlength=n)
    words = np.maximum(count, 1)
    hit = weight > 0
    capitals = np.concatenate([[0], np.cumsum(upper)])
    shouted = (capitals[plain_end] - capitals[plain_begin] == plain_end - plain_begin) & (
        plain_end - plain_begin > 1
    )
    person = np.isin(plain, _PERSONS)
    # Place of the nearest second-person word before and after each word of the batch.
    number = np.arange(len(plain))
    before = np.maximum.accumulate(np.where(person, number, -(1 << 40))) if len(plain) else number
    after = (
        np.minimum.accumulate(np.where(person, number, 1 << 40)[::-1])[::-1] if len(plain) else number
    )
    first = (np.cumsum(count) - count)[text]
    last = (np.cumsum(count))[text]
    near = ((before >= np.maximum(number - REACH, first)) | (after < np.minimum(number + REACH + 1, last))) & hit

    # Words between white space, read as if signs and digits were letters.
    begin, end = ragged.words(data, at, (data == 32) | ((data >= 9) & (data <= 13)))
    odd = np.concatenate([[0], np.cumsum(digit | sign | (data == 33))])
    letters = np.concatenate([[0], np.cumsum(letter)])
    mixed = (odd[end] > odd[begin]) & (letters[end] > letters[begin])
    undone = _DISGUISE[lower]
    disguised = np.zeros(len(begin), bool)
    if mixed.any():
        disguised[mixed] = lexicon.weigh(ragged.span_hashes(undone, begin[mixed], end[mixed])) > 0
    token_text = np.searchsorted(at, begin, "right") - 1
    tokens = np.maximum(np.bincount(token_text, minlength=n), 1)
    strongest = np.zeros(n)
    np.maximum.at(strongest, text[hit], weight[hit])
    per = lambda mask: np.bincount(text[mask], minlength=n) / words
    return np.column_stack(
        [
            per(hit),
            np.bincount(text[hit], minlength=n),
            strongest,
            np.bincount(text, weight, n) / words,
            np.bincount(token_text[disguised], minlength=n),
            np.bincount(text[near], minlength=n),
            per(person),
            rate(upper),
            per(shouted),
            rate(mark),
            rate(data == 33),
            rate(data == 63),
            rate(sign),
            rate(digit),
            rate(repeat),
            np.bincount(token_text[mixed], minlength=n) / tokens,
            count,
        ]
    ).astype(float)


def feature_column(lexicon: Lexicon, text: str = "text") -> Column:
    """The features as an array column."""

    def of(column: pa.Array) -> pa.Array:
        rows = [features(some, lexicon) for some in ragged.slices(column)]
        flat = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        ragged.released()
        ends = np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))

    return F.arrow_udf(of, "array<double>")(text)


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon, trees and calibration; without trees, a constant score."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words of (text, toxic) that are far commoner in toxic texts, each text counting once."""
    split = F.expr(r"split(lower(text), '[^\\p{L}]+')")
    words = rows.select("toxic", F.explode(F.array_distinct(split)).alias("word"))
    totals = rows.agg(F.expr("sum(toxic)").alias("bad"), F.expr("sum(1 - toxic)").alias("good")).first()
    counts = words.filter("word <> ''").groupBy("word")
    counts = counts.agg(F.expr("sum(toxic)").alias("bad"), F.expr("sum(1 - toxic)").alias("good"))
    ratio = f"((bad + 0.5) / {totals.bad + 1.0}) / ((good + 0.5) / {totals.good + 1.0})"
    found = (
        counts.withColumn("ratio", F.expr(ratio))
        .filter((F.col("bad") >= MIN_COUNT) & (F.col("ratio") >= MIN_RATIO))
        .orderBy(F.desc("ratio"), "word")
        .limit(LEXICON)
        .collect()
    )
    weights = [min(1.0, float(np.log2(float(r.ratio))) / 8) for r in found]
    return lexicon_of([r.word for r in found], weights)


def train(docs: DataFrame, labels: DataFrame, fold: str = "true", most: int = TRAIN_ROWS) -> ToxicityModel:
    """The model from documents (doc_id, text) and labels (doc_id, toxic) where `fold` holds."""
    known = labels.select("doc_id", F.expr("int(toxic <> 0)").alias("toxic")).filter("toxic IS NOT NULL")
    known = known.filter(fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most / max(1, known.count()))
    # A bounded side: about `most` narrow rows.
    chosen = F.broadcast(known.filter(F.expr("pmod(xxhash64(doc_id), 1000003)") < 1000003 * share))
    rows = settled(docs.select("doc_id", "text").join(chosen, "doc_id").repartition(8, "doc_id"))
    toxic, n = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not n or not 0 < toxic < n:
        return ToxicityModel(lexicon_of([], []), None, None, float(toxic or 0) / max(n, 1))
    calibrates = f"pmod(xxhash64(doc_id, 7), {FOLDS}) = 0"
    # The rows that calibrate have no part in the lexicon or the trees; if the others are of one
    # class, all rows serve for all.
    fits = rows.filter(f"NOT {calibrates}")
    bad, all_ = fits.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not all_ or not 0 < bad < all_:
        calibrates, fits = "false", rows
    lexicon = learn_lexicon(fits)
    vectors = rows.select(
        F.expr(calibrates).alias("calibrates"),
        F.col("toxic").cast("double").alias("label"),
        array_to_vector(feature_column(lexicon)).alias("features"),
    )
    vectors = settled(vectors.coalesce(4))
    trees = GBTClassifier(maxIter=30, maxDepth=4, stepSize=0.2, minInstancesPerNode=10, seed=1)
    model = trees.fit(vectors.filter("NOT calibrates"))
    own = vectors.filter("calibrates")
    own = raw_scores(own if own.take(1) else vectors, model)
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score")
    return ToxicityModel(lexicon, model, isotonic.fit(own.select("label", "raw")), 0.0)


def raw_scores(vectors: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """The frame with `raw`, the probability by the trees alone."""
    scored = model.transform(vectors).withColumn("raw", vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction", "features")


def scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every document."""
    if model.trees is None:
        return docs.select("doc_id", F.lit(model.constant).alias("score"))
    vectors = docs.select("doc_id", array_to_vector(feature_column(model.lexicon)).alias("features"))
    scored = model.calibration.transform(raw_scores(vectors, model.trees))
    return scored.select("doc_id", F.expr("greatest(0D, least(1D, score))").alias("score"))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a quarter is held out."""
    scored = scores(docs, train(docs, labels, training_fold()))
    return scored.select(
        "doc_id",
        F.expr(f"NOT {training_fold()}").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
