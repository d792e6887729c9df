"""Distances of vectors and cosine similarity of objects.

Distances are taken to a bounded list of reference rows, which is linear in the rows, or within a
sample. What compares rows with rows deals them into blocks of even size by a hash of their unique id
and compares block by block, so work is spread over block pairs and no group is large.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType

from ..scale.durable import buckets
from .summaries import top_per_group

BLOCK_ROWS = 2048
# The most rows of a block of ``cosine_similarity``: every row is sent to each block twice.
WIDE_ROWS = 16_384
# Rows by columns of the products that are looked at at a time.
TILE = 2048


def sample_rows(df: DataFrame, fraction: float | None = None, rows: int | None = None,
                seed: int = 1) -> DataFrame:
    """A random sample by fraction, or of about ``rows`` rows (all of a smaller table)."""
    if fraction is None:
        total = df.count()
        if rows is None or total <= rows:
            return df
        fraction = rows / total
    return df.sample(fraction=fraction, seed=seed)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two numeric array columns of equal length."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    def pairs(f) -> Column:
        return total(F.zip_with(a, b, f))

    def flag(c: Column) -> Column:
        return c.cast("int").cast("double")

    if metric == "cityblock":
        return pairs(lambda x, y: F.abs(x - y))
    if metric == "euclidean":
        return F.sqrt(pairs(lambda x, y: (x - y) * (x - y)))
    if metric == "cosine":
        def norm(v: Column) -> Column:
            return F.sqrt(total(F.transform(v, lambda x: x * x)))
        return 1 - pairs(lambda x, y: x * y) / (norm(a) * norm(b))
    if metric == "hamming":
        return pairs(lambda x, y: flag(x != y)) / F.size(a)
    if metric == "jaccard":
        either = pairs(lambda x, y: flag((x != 0) | (y != 0)))
        return F.when(either == 0, 0.0).otherwise(pairs(lambda x, y: flag(x != y)) / either)
    raise ValueError(f"unknown metric {metric!r}")


def _block_count(df: DataFrame, block_rows: int) -> int:
    return max(1, -(-df.count() // block_rows))


def _dealt(df: DataFrame, key: str, vector: str, blocks: int, kind: DataType) -> DataFrame:
    """Vectors of single floats stay so, as they are sent around."""
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    kind = ArrayType(FloatType() if single else DoubleType())
    return df.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v"),
                     F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))


def reference_distance(df: DataFrame, key: str, vector: str, references: Sequence,
                       metric: str = "cityblock") -> DataFrame:
    """(a, b, distance) of every row ``b`` to each row ``a`` whose key is among ``references``, a
    list from the caller, small by that."""
    vectors = df.select(F.col(key).alias("b"), F.col(vector).cast("array<double>").alias("v"))
    few = vectors.filter(F.col("b").isin(list(references))) \
        .select(F.col("b").alias("a"), F.col("v").alias("w"))
    asked = F.explode(F.array(*[F.lit(r) for r in references])).alias("a")
    return vectors.select("b", "v", asked).where("a != b").join(F.broadcast(few), "a") \
        .select("a", "b", distance(F.col("w"), F.col("v"), metric).alias("distance"))


def block_pairs(df: DataFrame, key: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, va, vb): every two rows, a < b, with a value of each."""
    blocks = _block_count(df, block_rows)
    dealt = df.select(F.col(key).alias("id"), F.col(value).alias("v"),
                      F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    left = dealt.select(F.col("id").alias("a"), F.col("v").alias("va"),
                        F.col("block").alias("i"),
                        F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"))
    right = dealt.select(F.col("id").alias("b"), F.col("v").alias("vb"),
                         F.explode(F.sequence(F.lit(0), "block")).alias("i"),
                         F.col("block").alias("j"))
    met = left.join(right, ["i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    swap = F.col("a") > F.col("b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                      F.when(swap, F.col("vb")).otherwise(F.col("va")).alias("va"),
                      F.when(swap, F.col("va")).otherwise(F.col("vb")).alias("vb"))


def pairwise_distance(sample: DataFrame, key: str, vector: str, metric: str = "cityblock",
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, distance) for every two rows of a sample, a < b."""
    vectors = sample.select(key, F.col(vector).cast("array<double>").alias("v"))
    return block_pairs(vectors, key, "v", block_rows).select(
        "a", "b", distance(F.col("va"), F.col("vb"), metric).alias("distance"))


def best_others(rows: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray,
                n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, product): for each row of ``x`` the ``n`` rows of ``y`` with other names and the
    greatest products, ties (equal to nine decimals) to the first name. ``others``, the names of
    ``y``, ascend. A tile adds only what beats the ``n`` found before it."""
    out = []
    lost_x, lost_y = ~np.isfinite(x).all(axis=1), ~np.isfinite(y).all(axis=1)
    for top in range(0, len(rows), TILE):
        ids = rows[top:top + TILE]
        every = np.arange(len(ids))
        at, to, product = np.empty(0, np.int64), np.empty(0, others.dtype), np.empty(0)
        least = np.full(len(ids), -np.inf)
        for left in range(0, len(others), TILE):
            names = others[left:left + TILE]
            tile = x[top:top + TILE] @ y[left:left + TILE].T
            tile[ids[:, None] == names[None, :]] = -np.inf
            tile[lost_x[top:top + TILE]] = -np.inf
            tile[:, lost_y[left:left + TILE]] = -np.inf
            bar = np.partition(tile, -n, axis=1)[:, -n] if left == 0 and len(names) > n else least
            i, j = np.nonzero(tile >= bar[:, None] - 1e-9)
            new = tile[i, j]
            known = np.isfinite(new)
            at, to = np.concatenate((at, i[known])), np.concatenate((to, names[j[known]]))
            product = np.concatenate((product, new[known]))
            order = np.lexsort((to, -np.round(product, 9), at))
            at, to, product = at[order], to[order], product[order]
            kept = np.arange(len(at)) - np.searchsorted(at, every)[at] < n
            at, to, product = at[kept], to[kept], product[kept]
            full = np.bincount(at, minlength=len(ids)) == n
            least[full] = np.round(product[np.searchsorted(at, every, side="right")[full] - 1], 9)
        out.append((ids[at], to, product))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def cosine_similarity(objects: DataFrame, key: str, vector: str, n: int = 10,
                      block_rows: int | None = None) -> DataFrame:
    """(id, other, similarity): for each object the ``n`` most similar others, exactly. Only
    the best ``n`` of a block leave the task that compares it. Ties (equal to nine decimals) go
    to the lower id. Blocks are as large as ``WIDE_ROWS``, or smaller where that leaves tasks without
    work."""
    if block_rows is None:
        total = objects.count()
        busy = math.isqrt(2 * buckets(objects.sparkSession)) + 1
        blocks = max(1, -(-total // WIDE_ROWS), min(busy, -(-total // BLOCK_ROWS)))
    else:
        blocks = _block_count(objects, block_rows)
    dealt = _dealt(objects, key, vector, blocks, objects.schema[vector].dataType)
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.select("id", "v", F.col("block").alias("i"), spread.alias("j"),
                        F.lit(True).alias("asks"))
    right = dealt.select("id", "v", spread.alias("i"), F.col("block").alias("j"),
                         F.lit(False).alias("asks"))

    def unit(frame: pd.DataFrame) -> np.ndarray:
        m = np.vstack(frame["v"].to_numpy()).astype("float64")
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        a, b = pair[pair["asks"]], pair[~pair["asks"]]
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "other": [], "similarity": []}) \
                .astype({"id": "int64", "other": "int64"})
        b = b.sort_values("id")
        found = best_others(a["id"].to_numpy(), unit(a), b["id"].to_numpy(), unit(b), n)
        return pd.DataFrame(dict(zip(("id", "other", "similarity"), found)))

    near = left.unionByName(right).groupBy("i", "j") \
        .applyInPandas(compare, "id long, other long, similarity double")
    near = near.withColumn("_order", F.round("similarity", 9))
    return top_per_group(near, "id", "other", "_order", n).drop("_order")
