"""Toxicity scores by FTRL-proximal logistic regression over hashed word grams.

Features of a text are the hashes of its words (A-Z folded, ASCII punctuation
deleted), of adjacent word pairs and of pairs with one word between (skip-
grams), as present or absent in ``2**BITS`` coordinates.  FTRL-proximal gives
each coordinate its own learning rate and an L1 term that leaves most weights
at exactly zero, so the fitted model is a short list of weights.

Fitting reads at most ``MAX_TRAIN`` labelled rows (those whose hashed ids are
smallest), whose features are extracted where the texts are.  The updates
are sequential, so they run over that bounded sample in one task.  Every
fifth training row is left out of them and fits the two parameters of a
logistic calibration of the margins.  The L1 term grows with the root of the
number of positive examples, as the noise of a coordinate's gradient does.  The model (at most ``2**BITS`` weights) is broadcast and every text
is scored whole in a pass without a shuffle.

Defined cases: null and empty texts have no features and get the calibrated
score of margin 0 plus the intercept; null or repeated ids are scored row by
row; a label row without a text, or with a null label, is not learned from;
of rows with one id and several labels each is an example; with no usable
labels every score is 0.5 and nothing is rejected; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tagweave.llm.common import WordHash, chunked, lean, mix, prepare, word_arrays, windows
from tagweave.workers import ship_by_value

BITS = 20
MAX_TRAIN = 20_000
EPOCHS = 3
THRESHOLD = 0.7
ALPHA, BETA, L2 = 3.0, 1.0, 0.0
#: L1 strength per root of the number of positive examples.
L1_RATE = 0.14
#: Bytes of text whose features a task holds at a time: they take some thirty times as much.
CHUNK = 1 << 20
_PUNCTUATION = string.punctuation.encode()
_SKIP = np.uint64(0x51C64E6D)


@dataclass
class Model:
    """Nonzero weights, intercept, and calibration ``sigmoid(slope * margin + shift)``."""

    coordinates: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float


def _dense(coordinates: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS)
    out[coordinates] = weights
    return out


def grams(texts: Iterable[str], cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features of all texts, and the text of each."""
    hashes, counts = word_arrays(texts, cache, lower=True, drop=_PUNCTUATION)
    keys, owner = [hashes], [np.repeat(np.arange(len(counts)), counts)]
    for width in (2, 3):
        at, doc = windows(counts, width)
        pair = mix(hashes[at], hashes[at + width - 1])
        keys.append(pair if width == 2 else pair * np.uint64(3) + _SKIP)
        owner.append(doc)
    keys = np.concatenate(keys) * np.uint64(0x9E3779B97F4A7C15)
    return (keys >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owner)


def _distinct(coordinates: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((owner << BITS) | coordinates)
    return pairs & ((1 << BITS) - 1), pairs >> BITS


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes over ``(coordinates, label)``."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    l1 = L1_RATE * np.sqrt(sum(label for _, label in examples))

    def weight(zi, ni):
        return np.where(
            np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        )

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at, label = examples[k]
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            g = _sigmoid(w.sum() + bias) - label
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    return weight(z, n), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA))


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit by Newton steps with a small ridge."""
    x = np.column_stack([margins, np.ones(len(margins))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        grad = x.T @ (p - labels) + 1e-3 * (beta - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -1, 1)
    return float(beta[0]), float(beta[1])


def _extract(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lean()
    cache = WordHash()
    for part in chunked(batches, max_bytes=CHUNK):
        coordinates, owner = _distinct(*grams(part["text"], cache))
        cuts = np.searchsorted(owner, np.arange(1, len(part)))
        yield pd.DataFrame(
            {
                "fitted": part["fitted"],
                "label": part["label"],
                "features": [x.astype(np.int32).tobytes() for x in np.split(coordinates, cuts)],
            }
        )


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    lean()
    rows = [(np.frombuffer(f, np.int32), int(y)) for f, y in zip(pdf["features"], pdf["label"])]
    w, bias = ftrl(rows)
    at = np.flatnonzero(w)
    return pd.DataFrame(
        {"coordinate": np.append(at, -1), "weight": np.append(w[at], bias)}
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    trainable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_train: int = MAX_TRAIN,
) -> Model:
    """Fit on the labelled rows that satisfy ``trainable`` (over the id as ``doc_id``)."""
    spark = prepare(docs.sparkSession)
    order = F.xxhash64(F.lit(3), F.col("doc_id").cast("string"))
    sample = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .filter(trainable)
        .orderBy(order, "doc_id", "label")
        .limit(max_train)
    )
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .select(
            (F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(5)) != 0).alias("fitted"), "label", "text"
        )
        .mapInPandas(_extract, "fitted boolean, label int, features binary")
        .checkpoint()
    )
    trained = (
        rows.filter("fitted")
        .groupBy("fitted")
        .applyInPandas(_train, "coordinate long, weight double")
        .toPandas()
    )
    bias = float(trained.loc[trained["coordinate"] < 0, "weight"].sum())
    trained = trained[trained["coordinate"] >= 0].sort_values("coordinate")
    model = Model(trained["coordinate"].to_numpy(), trained["weight"].to_numpy(), 1.0, bias)
    shared = spark.sparkContext.broadcast((model.coordinates, model.weights))

    def margins(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        dense = _dense(*shared.value)
        for pdf in batches:
            sums = [float(dense[np.frombuffer(f, np.int32)].sum()) for f in pdf["features"]]
            yield pd.DataFrame({"margin": sums, "label": pdf["label"]})

    held = rows.filter("not fitted").mapInPandas(margins, "margin double, label int").toPandas()
    if held["label"].nunique() == 2:
        model.slope, model.shift = calibrate(held["margin"].to_numpy(), held["label"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the model's probability of label 1."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.coordinates, model.weights))
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    slope, shift = model.slope, model.shift
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        dense, cache = _dense(*shared.value), WordHash()
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            sums = np.zeros(len(texts))
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < CHUNK):
                    size += len(texts[end])
                    end += 1
                coordinates, owner = grams(texts[at:end], cache)
                hit = dense[coordinates] != 0
                coordinates, owner = _distinct(coordinates[hit], owner[hit])
                sums[at:end] = np.bincount(owner, dense[coordinates], end - at)
                at = end
            scores = _sigmoid(slope * sums + shift)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, schema)


def crc_fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Rows whose crc32(id as text) mod 3 is 1 are held out of fitting; a null id is not.
    """
    model = fit(docs, labels, crc_fold("doc_id", 3) != 1, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return score(rows, model).select(
        "doc_id",
        F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


ship_by_value(__name__)
