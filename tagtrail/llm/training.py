"""Labelled samples and rounds of parameter averaging for the linear models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale.durable import stored

#: Rows that a model is fitted on, about (each labelled id is drawn with the same chance).
SAMPLE_ROWS = 12_000
SHARDS = 16
_GRAIN = 1 << 30


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column,
                    rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y, shard): about ``rows`` documents with a label of 0 or 1 for which ``learn``, a
    condition on ``doc_id``, holds. They are drawn by a hash of the id, so the same rows are drawn
    again. Ids whose labels disagree and null ids or texts are left out; a repeated id counts
    once."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
             .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most"))
             .where("y = most").select("doc_id", F.col("y").cast("int").alias("y")))
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(_GRAIN))
                        < F.lit(int(share * _GRAIN)))
    # At most about ``rows`` ids, whatever the input: small enough to send everywhere.
    found = (documents.select("doc_id", "text").where("text IS NOT NULL")
             .join(F.broadcast(drawn), "doc_id")
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
    return stored(found.select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))
                               .cast("int").alias("shard")), "sample")


def averaged_rounds(sample: DataFrame, start: np.ndarray, rounds: int,
                    fit: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Each round fits every shard from the common state and averages the states by the rows
    behind them. A state is an array of a fixed size, so a round brings ``SHARDS`` of them to the
    driver however large the corpus is."""
    state = start.astype(np.float32)
    context = sample.sparkSession.sparkContext
    for _ in range(rounds):
        common = context.broadcast(state)

        def one(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("doc_id")
            out = fit(common.value.astype(np.float64), part)
            return pd.DataFrame({"n": [len(part)],
                                 "state": [out.astype(np.float32).tobytes()]})

        made = sample.groupBy("shard").applyInPandas(one, "n long, state binary").collect()
        common.unpersist()
        if not made:
            break
        total = sum(r["n"] for r in made)
        state = sum((np.frombuffer(r["state"], np.float32).astype(np.float64).reshape(start.shape)
                     * (r["n"] / total) for r in sorted(made, key=lambda r: r["state"])),
                    np.zeros(start.shape)).astype(np.float32)
    return state


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, x)))))
