"""Language identification by rank order of character n-grams.

The 1- to 3-grams of the words of a text (lower-cased, letters only, a space before and after each)
are ranked by frequency, ties by code points; the first 300 are its profile. The distance to a
language is the sum over the profile of how far each n-gram is from its place in the language's
profile, 300 where it has none. The nearest language wins, ties going to the smaller name. The score
is 1 - distance / (300 * n-grams).

A text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be
learned. Language profiles come from about ``rows`` documents per language drawn by a hash of the
id; nulls in id, text or language take no part in learning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import codes, is_kind

PROFILE = 300
ROWS_PER_LANGUAGE = 3000
UNDECIDED = "und"
_GRAIN = 1 << 30


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, three code points of 21 bits packed into one word, and their counts."""
    points = codes((text or "").lower())
    letter = is_kind(points, "letter")
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.concatenate(([0], np.where(letter, points, 0), [0])).astype(np.uint64)
    c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    # A zero marks the edge of a word; a gram across two words has one in its middle.
    grams = np.concatenate((c[c != 0], two | np.uint64(1 << 63), three[c[1:-1] != 0]))
    return np.unique(grams, return_counts=True)


def profile(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


def train(documents: DataFrame, learn: Column, rows: int = ROWS_PER_LANGUAGE) \
        -> dict[str, np.ndarray]:
    """Language profiles, 300 n-grams each, from documents for which ``learn`` holds."""
    known = documents.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & learn)
    shares = known.groupBy("lang").agg(F.count(F.lit(1)).alias("all"))
    drawn = (known.join(shares, "lang")
             .where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(_GRAIN)) * F.col("all")
                    < F.lit(rows * _GRAIN)))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                pairs = [gram_counts(t) for t in part["text"]]
                grams, at = np.unique(np.concatenate([g for g, _ in pairs]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in pairs]), len(grams))
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64),
                                    "n": n.astype(np.int64)})

    totals = (drawn.select("lang", "text").mapInPandas(counted, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # Ties by the packed gram as an unsigned number, as in ``profile``.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    best = (totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
            .orderBy("lang", "rank").collect())  # 300 per language
    out: dict[str, list[int]] = {}
    for r in best:
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


def nearest(text: str | None, languages: dict[str, tuple[np.ndarray, np.ndarray]]) \
        -> tuple[str, float]:
    """``languages`` holds sorted n-grams and their places, by name in ascending order."""
    own = profile(*gram_counts(text))
    if not len(own) or not languages:
        return UNDECIDED, 0.0
    places = np.arange(len(own))
    best, least = UNDECIDED, None
    for name, (grams, ranks) in languages.items():
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        out = np.where(grams[at] == own, np.abs(ranks[at] - places), PROFILE).sum()
        if least is None or out < least:
            best, least = name, int(out)
    return best, 1.0 - least / (PROFILE * len(own))


def identify(documents: DataFrame, profiles: dict[str, np.ndarray], text: str = "text",
             lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``documents`` with the nearest language and its score."""
    ready = {}
    for name in sorted(profiles):
        order = np.argsort(profiles[name])
        ready[name] = (profiles[name][order], order)
    shared = documents.sparkSession.sparkContext.broadcast(ready)  # 5 kB a language

    @F.pandas_udf("lang string, score double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([nearest(t, shared.value) for t in batch],
                               columns=["lang", "score"])

    return (documents.withColumn("_found", found(F.col(text)))
            .withColumn(lang, F.col("_found.lang")).withColumn(score, F.col("_found.score"))
            .drop("_found"))
