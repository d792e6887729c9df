"""Exact top-k search by inner product with a pivot-distance index.

Vectors are quantised to floor(256 * x). Adding one coordinate, sqrt(M**2 - |x|**2) with M the largest
length (0 for queries), turns the largest inner product into the smallest distance. Every row is
keyed by its nearest pivot and its distance to it; the distances of a pivot's rows are cut into rings,
so a cell of the index is an annulus. Pivots and ring edges are fitted on about ``SAMPLE_ROWS`` rows;
every row is indexed, and the results are exact whatever they are.

A query starts from the best it can do within the sample. By the triangle inequality a row x of pivot
p is at least |d(q, p) - d(x, p)| away, so whole cells are left out, and within a cell the search goes
outwards from d(q, p) over the sorted distances and stops where the bound passes the k-th best so far.
Cells of more than ``CELL_ROWS`` rows, as of one vector that many rows share, are dealt over several
tasks. The list of cells has ``PIVOTS * RINGS`` entries at any size.

Vectors that are null, hold null or a number that isn't finite, and rows with a null id take no part.
Shorter vectors count as continued by zeros. Rows equal in id and vector are one row; the candidates
of a query are all rows with another id. Ties go to the smaller id. Inner products are exact; those
beyond the range of a long become its largest or smallest value. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale.durable import stored
from .stream import map_groups

PIVOTS, RINGS = 16, 4
SAMPLE_ROWS, CELL_ROWS, STEP = 2048, 4096, 256
_GRAIN = 1 << 30
_LONG = 2 ** 63 - 1


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # id, packed, dist, cell, salt
    pivots: np.ndarray  # with the added coordinate
    longest: float  # square of M
    width: int
    sample_ids: np.ndarray
    sample: np.ndarray
    cells: np.ndarray  # cell, tasks, least and largest distance


def quantised(vector, width: int) -> np.ndarray:
    v = np.floor(256.0 * np.asarray(vector, dtype=np.float64))
    return np.concatenate((v, np.zeros(width - len(v))))


def products(rows: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; with ``exact`` floats hold them as they are."""
    if exact:
        return (rows @ q).astype(np.int64)
    own = [int(x) for x in q]
    return np.array([max(-_LONG - 1, min(_LONG, sum(int(x) * y for x, y in zip(r, own))))
                     for r in rows], dtype=np.int64)


def _raised(v: np.ndarray, longest: float) -> np.ndarray:
    rest = np.maximum(0.0, longest - (v * v).sum(axis=1))
    return np.column_stack((v, np.sqrt(rest)))


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Centres of a few rounds of k-means from rows far from each other."""
    at = [0]
    far = np.full(len(sample), np.inf)
    for _ in range(min(PIVOTS, len(sample)) - 1):
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
        at.append(int(far.argmax()))
    centres = sample[at]
    for _ in range(5):
        near = _distances(sample, centres).argmin(axis=1)
        centres = np.stack([sample[near == i].mean(axis=0) if (near == i).any() else c
                            for i, c in enumerate(centres)])
    return centres


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)))


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> Index | None:
    """The index of all rows that take part; None if there are none."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = stored(vectors.select(F.col(key).cast("long").alias("id"),
                                   F.col(vector).cast("array<double>").alias("vector"))
                    .where("id IS NOT NULL AND vector IS NOT NULL").where(~bad), "vectors")
    square = F.aggregate("vector", F.lit(0.0),
                         lambda s, x: s + F.pow(F.floor(x * 256).cast("double"), F.lit(2.0)))
    n, width, longest = usable.agg(F.count(F.lit(1)), F.max(F.size("vector")),
                                   F.max(square)).first()
    if not n:
        return None
    # Beyond this, floats don't hold the products and no bound is used.
    longest = float("inf") if longest >= 2.0 ** 52 else longest
    drawn = usable.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(_GRAIN))
                         < F.lit(int(min(1.0, SAMPLE_ROWS / n) * _GRAIN))).distinct().toPandas()
    drawn = drawn.sort_values("id", kind="stable")
    sample = np.zeros((len(drawn), width))
    for i, v in enumerate(drawn["vector"]):
        sample[i] = quantised(v, width)
    finite = np.isfinite(longest)
    raised = _raised(sample, longest) if finite else np.zeros((len(sample), width + 1))
    pivots = _pivots(raised) if len(sample) else np.zeros((1, width + 1))
    distances = _distances(raised, pivots)
    near = distances.argmin(axis=1)
    edges = [np.quantile(distances[near == i, i], np.arange(1, RINGS) / RINGS)
             if (near == i).any() else np.zeros(RINGS - 1) for i in range(len(pivots))]

    @F.pandas_udf("packed binary, cell int, dist double")
    def keyed(batch: pd.Series) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({"packed": [], "cell": [], "dist": []})
        v = np.stack([quantised(x, width) for x in batch])
        if finite:
            d = _distances(_raised(v, longest), pivots)
            p = d.argmin(axis=1)
            dist = d[np.arange(len(v)), p]
        else:
            p, dist = np.zeros(len(v), int), np.zeros(len(v))
        ring = [int(np.searchsorted(edges[i], x)) for i, x in zip(p, dist)]
        return pd.DataFrame({"packed": [x.tobytes() for x in v], "cell": p * RINGS + ring,
                             "dist": dist})

    rows = stored(usable.select("id", keyed("vector").alias("k")).select("id", "k.*"), "keyed")
    found = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist"),
                                     F.max("dist")).orderBy("cell").collect()  # PIVOTS * RINGS
    cells = np.array([(r[0], -(-r[1] // CELL_ROWS), r[2], r[3]) for r in found])
    tasks = F.create_map(*[F.lit(int(x)) for c in cells for x in c[:2]])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), tasks[F.col("cell")]).cast("int"))
    return Index(rows, pivots, longest, width, drawn["id"].to_numpy(np.int64), sample, cells)


def top_k(index: Index, queries: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each indexed row for which ``queries``, a condition on
    ``id``, holds, the ``k`` rows with other ids of the highest score."""
    width, longest, pivots = index.width, index.longest, index.pivots
    exact = bool(np.isfinite(longest))
    cells, sample, sample_ids = index.cells, index.sample, index.sample_ids
    shared = index.rows.sparkSession.sparkContext.broadcast((sample, sample_ids))

    def far(q: np.ndarray, score: float) -> float:
        """Distance that goes with a score, a little more for rounding."""
        return np.sqrt(max(0.0, (q * q).sum() + longest - 2.0 * score)) * (1 + 1e-9) + 1e-6

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, sample_ids = shared.value
        for frame in frames:
            out = []
            for i, packed in zip(frame["id"], frame["packed"]):
                q = np.frombuffer(packed)
                reach, least = np.inf, -_LONG - 1
                places = np.zeros(len(pivots))
                if exact:
                    scores = products(sample[sample_ids != i], q, exact)
                    if len(scores) >= k:
                        least = int(np.partition(scores, len(scores) - k)[len(scores) - k])
                        reach = far(q, least)
                    places = np.sqrt(((np.append(q, 0.0) - pivots) ** 2).sum(axis=1))
                for cell, tasks, low, high in cells:
                    at = places[int(cell) // RINGS]
                    if exact and max(at - high, low - at) > reach:
                        continue
                    out += [(int(cell), salt, i, packed, at, least) for salt in range(int(tasks))]
            yield pd.DataFrame(out, columns=["cell", "salt", "id", "packed", "dist", "least"])

    asked = index.rows.where(queries).select("id", "packed").dropDuplicates(["id", "packed"])
    routed = asked.mapInPandas(route, "cell int, salt int, id long, packed binary, dist double, "
                                      "least long")
    kept = index.rows.select("cell", "salt", "id", "packed", "dist",
                             F.lit(None).cast("long").alias("least"))
    both = routed.withColumn("asks", F.lit(True)).unionByName(kept.withColumn("asks", F.lit(False)))

    def expand(group: pd.DataFrame) -> pd.DataFrame | None:
        asks = group["asks"].to_numpy(bool)
        if not asks.any() or asks.all():
            return None
        own = group[~asks].drop_duplicates(["id", "packed"]).sort_values(["dist", "id"])
        rows = np.stack([np.frombuffer(p) for p in own["packed"]])
        ids, dist = own["id"].to_numpy(np.int64), own["dist"].to_numpy()
        out = []
        for i, packed, at, least in group.loc[asks, ["id", "packed", "dist", "least"]] \
                .itertuples(index=False):
            q, least = np.frombuffer(packed), int(least)
            best: list[tuple[int, int]] = []  # (-score, id)
            reach = far(q, least) if exact and least > -_LONG - 1 else np.inf
            low = high = int(np.searchsorted(dist, at))
            # Outwards, STEP rows on the nearer side at a time.
            while True:
                down = at - dist[low - 1] if low else np.inf
                up = dist[high] - at if high < len(dist) else np.inf
                if not low and high == len(dist) or exact and min(down, up) > reach:
                    break
                if low and (down <= up or high == len(dist)):
                    part = slice(max(0, low - STEP), low)
                    low = part.start
                else:
                    part = slice(high, min(len(dist), high + STEP))
                    high = part.stop
                scores = products(rows[part], q, exact)
                good = np.flatnonzero((scores >= least) & (ids[part] != i))
                if len(good):
                    new = sorted(zip((-scores[good].astype(object)).tolist(),
                                     ids[part][good].tolist()))
                    best = sorted(best + new[:k])[:k]
                    if len(best) == k and -best[-1][0] > least:
                        least = -best[-1][0]
                        reach = far(q, least) if exact else np.inf
            out += [(i, other, -score, packed) for score, other in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "packed"])

    found = map_groups(both, ["cell", "salt"], expand,
                       "query_id long, vec_id long, score long, packed binary")
    order = Window.partitionBy("query_id", "packed").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
