"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features of a document are which hashed 3- to 5-grams of its lower-cased text occur (2**18
places; anything but letters and digits reads as one space). Each is scaled by the log ratio of its
smoothed share among toxic and other training texts; a logistic regression on the scaled features is
fitted by gradient steps on shards of the sample, averaged each round.

Null and empty texts get the score of the bias. Repeated rows are scored one by one; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import codes, is_kind
from .training import SAMPLE_ROWS, averaged_rounds, labelled_sample, sigmoid

BITS = 18
PLACES = 1 << BITS
ORDERS = (3, 4, 5)
ROUNDS, EPOCHS, RATE = 4, 2, 0.005
CUT = 0.5
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_SPACE = np.uint32(32)
_SLICE = 1 << 12


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # with the ratios multiplied in
    bias: float


class Grams:
    """Places of the n-grams that occur in a text; keeps one bitmap for all texts."""

    def __init__(self) -> None:
        self.seen = np.zeros(PLACES, dtype=bool)

    def __call__(self, text: str | None) -> np.ndarray:
        points = codes((text or "").lower())
        points = np.where(is_kind(points, "word"), points, _SPACE)
        points = np.concatenate(([_SPACE], points, [_SPACE]))
        blank = points == _SPACE
        points = points[np.append(True, ~(blank[1:] & blank[:-1]))]
        h = points
        for n in range(2, max(ORDERS) + 1):
            if len(h) < 2:
                break
            h = h[:-1] * _A + points[n - 1:]
            if n in ORDERS:
                self.seen[((h ^ (h >> np.uint32(15))) * _B) >> np.uint32(32 - BITS)] = True
        places = np.flatnonzero(self.seen)
        self.seen[places] = False
        return places


def _ratios(sample: DataFrame) -> np.ndarray:
    """Log of the smoothed share of each place among texts of label 1 over that of label 0."""

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, seen = Grams(), np.zeros((2, PLACES), np.int64)
        size = [0, 0]
        for frame in frames:
            for text, y in zip(frame["text"], frame["y"]):
                seen[y][grams(text)] += 1
                size[y] += 1
        for y in (0, 1):
            at = np.flatnonzero(seen[y])
            yield pd.DataFrame({"y": y, "place": np.append(at, PLACES),
                                "n": np.append(seen[y][at], size[y])})

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((2, _SLICE), np.int64)
        block[part["y"], part["place"] % _SLICE] = part["n"]
        return pd.DataFrame({"slice": part["slice"].iloc[:1], "packed": [block.tobytes()]})

    # The driver gets a row for each slice of places, 4 MB in all, not one for each place.
    rows = (sample.mapInPandas(counts, "y int, place long, n long")
            .groupBy("y", "place").agg(F.sum("n").alias("n"))
            .withColumn("slice", F.floor(F.col("place") / _SLICE).cast("int"))
            .groupBy("slice").applyInPandas(pack, "slice int, packed binary").collect())
    found = np.zeros((2, PLACES + _SLICE))  # the sizes stand behind the last place
    for r in rows:
        found[:, r["slice"] * _SLICE:(r["slice"] + 1) * _SLICE] = \
            np.frombuffer(r["packed"], np.int64).reshape(2, _SLICE)
    found = found[:, :PLACES + 1]
    share = (found[:, :PLACES] + 1) / (found[:, PLACES:] + 2)
    return np.log(share[1] / share[0])


def train(documents: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic",
          rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``rows`` labelled documents for which ``learn`` holds. Without any, nothing is
    known to be toxic and every score is next to 0."""
    sample = labelled_sample(documents, labels, label, learn, rows)
    if sample.isEmpty():
        return Model(np.zeros(PLACES, np.float32), -35.0)
    ratios = _ratios(sample).astype(np.float32)
    shared = sample.sparkSession.sparkContext.broadcast(ratios)

    def fit(state: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        grams, ratio = Grams(), shared.value
        rows = [(p := grams(t), ratio[p].astype(np.float64), y)
                for t, y in zip(part["text"], part["y"])]
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                places, scaled, y = rows[i]
                miss = sigmoid(float(state[places] @ scaled) + state[PLACES]) - y
                state[places] -= RATE * miss * scaled
                state[PLACES] -= RATE * miss
        return state

    w = averaged_rounds(sample, np.zeros(PLACES + 1), ROUNDS, fit)
    return Model((w[:PLACES] * ratios).astype(np.float32), float(w[PLACES]))


def score(documents: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``documents`` with the probability of label 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 1 MB at any corpus size

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, grams = shared.value, Grams()
        for batch in batches:
            yield pd.Series([sigmoid(float(model.weights[grams(t)].sum(dtype=np.float64))
                                     + model.bias) for t in batch], dtype="float64")

    return documents.withColumn(to, scored(F.col(text)))
