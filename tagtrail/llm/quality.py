"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL-proximal.

A document is a sparse unit vector of the square roots of its token uni- and bigram counts, hashed
into 2**18 places; tokens are runs of letters and digits or runs of other signs of the lower-cased
text, and a token that repeats its predecessor adds a place of its own. The updates follow the
regularised leader coordinate by coordinate; shards of the sample do so in parallel and average
their accumulators after each round. A score is the logistic value of a sparse dot product.

Null and empty texts have no features and get the score of the bias. Repeated ids are scored row by
row; other columns of the tables are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import codes, is_kind, mix, ngrams, span_hashes
from .training import SAMPLE_ROWS, averaged_rounds, labelled_sample, sigmoid

BITS = 18
PLACES = 1 << BITS
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.2, 0.0
ROUNDS, EPOCHS = 3, 2
_REPEAT = np.uint64(0x51A7F00D)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def tokens(text: str) -> np.ndarray:
    points = codes(text.lower())
    if not len(points):
        return np.empty(0, np.uint64)
    kind = np.where(is_kind(points, "space"), 0, np.where(is_kind(points, "word"), 1, 2))
    edges = np.flatnonzero(np.diff(kind)) + 1
    starts, ends = np.append(0, edges), np.append(edges, len(points))
    kept = kind[starts] != 0
    return span_hashes(points, starts[kept], ends[kept])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the sparse vector."""
    t = tokens(text or "")
    again = np.full(int((t[1:] == t[:-1]).sum()), _REPEAT)
    hashed = mix(np.concatenate((t, ngrams(t, 2), again))) >> np.uint64(64 - BITS)
    places, counts = np.unique(hashed.astype(np.int64), return_counts=True)
    return places, np.sqrt(counts / max(1, counts.sum()))


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that minimise the regularised sum of past losses."""
    return np.where(np.abs(z) <= L1, 0.0,
                    (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _fit(state: np.ndarray, part: pd.DataFrame) -> np.ndarray:
    z, n = state
    rows = [(np.append(p, PLACES), np.append(v, 1.0), y)
            for (p, v), y in zip(map(features, part["text"]), part["y"])]
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            places, values, y = rows[i]
            zi, ni = z[places], n[places]
            w = _leader(zi, ni)
            g = (sigmoid(w @ values) - y) * values
            grown = ni + g * g
            z[places] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[places] = grown
    return np.stack((z, n))


def train(documents: DataFrame, labels: DataFrame, learn: Column, label: str = "quality",
          rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``rows`` labelled documents for which ``learn`` holds. Without any, every
    score is 0.5."""
    sample = labelled_sample(documents, labels, label, learn, rows)
    z, n = averaged_rounds(sample, np.zeros((2, PLACES + 1)), ROUNDS, _fit).astype(np.float64)
    w = _leader(z, n)
    return Model(w[:PLACES].astype(np.float32), float(w[PLACES]))


def score(documents: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``documents`` with the probability of label 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 1 MB at any corpus size

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            out = []
            for t in batch:
                places, values = features(t)
                out.append(sigmoid(float(model.weights[places] @ values) + model.bias))
            yield pd.Series(out, dtype="float64")

    return documents.withColumn(to, scored(F.col(text)))
