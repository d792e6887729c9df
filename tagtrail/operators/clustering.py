"""PCA and clustering of feature vectors.

PCA is a tall-skinny QR: each task reduces its scaled rows to one triangle, triangles are stacked and
reduced by sixteens, and the last one has the singular values and components of all rows. No product of
the rows with themselves is formed, so small components keep their digits. A triangle of the width of
the features is what a task or the driver holds.

K-means runs all numbers of clusters and all starts in the same passes over the rows. What tasks share
and send are the centres of the runs still moving, never rows; sums of tasks are added in two steps.
Seeds are drawn one after another in proportion to the squared distance from those before (k-means++):
every row runs an exponential race against the others, with a hash of its key, the start and the place
as its randomness, and the fastest wins. Draws so repeat whatever the partitions, and the first k of a
longer series are the seeds of k clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from ..scale.durable import release, stored

_STACK = 16
_ROWS = 256
_MERGE = 64


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def from_array(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def _as_array(df: DataFrame, features: str) -> Column:
    if isinstance(df.schema[features].dataType, VectorUDT):
        return vector_to_array(features)
    return F.col(features).cast("array<double>")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.empty((0, 0))


# --- PCA -------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Components:
    """Share of variance and loadings of each component, and the rows projected on them."""

    ratios: list[float]
    loadings: np.ndarray
    projected: DataFrame


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _reduced(df: DataFrame, features: str, centre: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The triangle of all scaled rows."""
    width = len(centre)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.empty((0, width))
        for frame in frames:
            if len(frame):
                r = _triangle(np.vstack((r, (_matrix(frame["v"]) - centre) * factor)))
        yield pd.DataFrame({"packed": [r.tobytes()]})

    def stack(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(p).reshape(-1, width) for p in group["packed"]]
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // _STACK],
                             "packed": [_triangle(np.vstack(parts)).tobytes()]})

    rows = df.select(_as_array(df, features).alias("v"))
    tree = rows.mapInPandas(fold, "packed binary").withColumn("part", F.spark_partition_id())
    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        tree = tree.groupBy(F.floor(F.col("part") / _STACK).alias("stack")) \
            .applyInPandas(stack, "part int, packed binary")
        parts = -(-parts // _STACK)
    return np.frombuffer(tree.first()["packed"]).reshape(-1, width)


def pca(df: DataFrame, n: int, features: str = "features", out: str = "pca") -> Components:
    """z-scores by the population deviation (0 for constant features), projected on the ``n`` leading
    components; the largest loading of a component is positive. ``out`` is an array column."""
    measured = Summarizer.metrics("mean", "variance", "count").summary(
        array_to_vector(_as_array(df, features)))
    stats = df.agg(measured.alias("s")).first()["s"]
    centre, count = stats["mean"].toArray(), stats["count"]
    spread = np.sqrt(stats["variance"].toArray() * ((count - 1) / count if count else 0))
    # What rounding leaves of a constant feature is no spread.
    moves = spread > 1e-12 * np.maximum(1, np.abs(centre))
    factor = np.divide(1, spread, out=np.zeros_like(spread), where=moves)
    _, values, loadings = np.linalg.svd(_reduced(df, features, centre, factor), full_matrices=False)
    loadings = loadings[:n]
    most = loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)]
    loadings = loadings * np.where(most < 0, -1.0, 1.0)[:, None]
    total = float((values ** 2).sum())
    shared = (loadings * factor).T

    @F.pandas_udf(ArrayType(DoubleType()))
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list((_matrix(v) - centre) @ shared)) if len(v) else v

    ratios = [float(x * x) / total if total else 0.0 for x in values[:n]]
    return Components(ratios, loadings, df.withColumn(out, project(_as_array(df, features))))


def scree(df: DataFrame, n: int, features: str = "features") -> DataFrame:
    """(component, ratio, cumulative): variance shares, with a leading zero row."""
    ratios = pca(df, n, features).ratios
    running = Window.orderBy("component")
    rows = [(i, float(r)) for i, r in enumerate([0.0, *ratios])]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double") \
        .withColumn("cumulative", F.sum("ratio").over(running))


# --- k-means ---------------------------------------------------------------------------------------

def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit words with every bit spread over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(keys: np.ndarray, starts: int, place: int, seed: int) -> np.ndarray:
    """Numbers in (0, 1), a row per key and a column per start."""
    salt = _mixed(np.arange(1, starts + 1, dtype=np.uint64)
                  + np.uint64((seed * 1_000_003 + place) * 0x9E3779B97F4A7C15 % 2 ** 64))
    h = _mixed(keys.astype(np.int64).view(np.uint64)[:, None] ^ salt[None, :])
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]
    return np.maximum(d, 0)


def race(keys: np.ndarray, x: np.ndarray, chosen: np.ndarray, seed: int) -> np.ndarray:
    """Finish times of the rows for the next seed of each start, given ``chosen`` (starts, seeds so
    far, width): the smaller, the sooner."""
    starts, place, width = chosen.shape
    weight = np.ones((len(x), starts))
    if place:
        near = _squared(x, chosen.reshape(-1, width)).reshape(len(x), starts, place).min(axis=2)
        # What rounding leaves of the distance of a row from itself is none.
        weight = np.where(near > 1e-12 * np.maximum(1, (x * x).sum(axis=1))[:, None], near, 0)
    with np.errstate(divide="ignore"):
        return -np.log(uniform(keys, starts, place, seed)) / weight


@dataclass(frozen=True)
class Fit:
    """The best of the starts for a number of clusters: its centres and cost, and the size, the sum of
    squared norms and the sum of the rows of each cluster."""

    k: int
    start: int
    cost: float
    centres: np.ndarray
    sizes: np.ndarray
    squares: np.ndarray
    sums: np.ndarray


def _pieces(frames: Iterable[pd.DataFrame], rows: int = _ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for frame in frames:
        for low in range(0, len(frame), rows):
            part = frame.iloc[low:low + rows]
            yield part["h"].to_numpy(np.int64), _matrix(part["v"])


def _seeds(points: DataFrame, k: int, starts: int, seed: int) -> np.ndarray:
    """(starts, k, width): seeds of each start in the order drawn. Rows beyond the distinct ones are
    seeds again, and their clusters stay empty."""
    context = points.sparkSession.sparkContext
    chosen: np.ndarray | None = None
    for place in range(k):
        shared = context.broadcast(chosen)

        def draw(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            best: list = [None] * starts
            for keys, x in _pieces(frames):
                so_far = shared.value if shared.value is not None else \
                    np.empty((starts, 0, x.shape[1]))
                times = race(keys, x, so_far, seed)
                for s, at in enumerate(times.argmin(axis=0)):
                    mine = (float(times[at, s]), int(keys[at]), x[at].tolist())
                    if best[s] is None or mine < best[s]:
                        best[s] = mine
            rows = [(s, *b) for s, b in enumerate(best) if b is not None]
            yield pd.DataFrame(rows, columns=["start", "time", "h", "v"])

        won = points.mapInPandas(draw, "start int, time double, h long, v array<double>") \
            .groupBy("start").agg(F.min(F.struct("time", "h", "v")).alias("won")).orderBy("start") \
            .collect()
        new = np.array([r["won"]["v"] for r in won])[:, None, :]
        chosen = new if chosen is None else np.concatenate((chosen, new), axis=1)
        shared.unpersist()
    return chosen


def _added(packed: pd.Series) -> bytes:
    out = np.zeros(len(packed.iloc[0]) // 8)
    for p in packed:
        out += np.frombuffer(p)
    return out.tobytes()


def _merged(parts: DataFrame, keys: Sequence[str], add: Callable[[pd.DataFrame], pd.DataFrame],
            schema: str, tasks: int) -> DataFrame:
    """What the tasks have summed, added up per key; in two steps where there are many tasks."""
    if tasks > _MERGE:
        parts = parts.groupBy(*keys, F.pmod(F.spark_partition_id(), F.lit(_MERGE)).alias("m")) \
            .applyInPandas(add, schema)
    return parts.groupBy(*keys).applyInPandas(add, schema)


def _sums(points: DataFrame, centres: dict[tuple[int, int], np.ndarray]) \
        -> dict[tuple[int, int], np.ndarray]:
    """Per run a row per cluster: size, cost, squared norms, and the sum of its rows."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = shared.value
        names = list(runs)
        every = np.concatenate([runs[n] for n in names])
        bounds = np.cumsum([0, *(len(runs[n]) for n in names)])
        total = np.zeros((len(every), every.shape[1] + 3))
        for _, x in _pieces(frames):
            norms = (x * x).sum(axis=1)
            d = _squared(x, every)
            wide = np.hstack((np.ones((len(x), 1)), np.zeros((len(x), 1)), norms[:, None], x))
            for low, high in zip(bounds, bounds[1:]):
                part = d[:, low:high]
                label = part.argmin(axis=1)
                wide[:, 1] = part[np.arange(len(x)), label]
                member = np.zeros((high - low, len(x)))
                member[label, np.arange(len(x))] = 1
                total[low:high] += member @ wide
        yield pd.DataFrame({"k": [k for k, _ in names], "start": [s for _, s in names], "packed": [
            total[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": group["k"].iloc[:1], "start": group["start"].iloc[:1],
                             "packed": [_added(group["packed"])]})

    schema = "k int, start int, packed binary"
    rows = _merged(points.mapInPandas(fold, schema), ["k", "start"], add, schema,
                   points.rdd.getNumPartitions()).collect()
    shared.unpersist()
    return {(r["k"], r["start"]): np.frombuffer(r["packed"]).reshape(r["k"], -1) for r in rows}


def _rounds(points: DataFrame, centres: dict[tuple[int, int], np.ndarray]) \
        -> dict[tuple[int, int], np.ndarray]:
    """As ``_sums``, but of each cluster only the size and the sum of its rows, which is all that moves
    the centres. All starts of a k are one product with few enough columns to stay in the cache. A row's
    own norm, the same for all centres, is left out; a centre that repeats an earlier one of its run
    never is the nearest."""
    groups: dict[int, tuple[list[int], np.ndarray]] = {}
    for k in sorted({k for k, _ in centres}):
        starts = sorted(s for n, s in centres if n == k)
        every = np.stack([centres[k, s] for s in starts])
        norms = (every * every).sum(axis=2)
        for run, own in zip(every, norms):
            kept = np.unique(run, axis=0, return_index=True)[1]
            own[np.setdiff1d(np.arange(k), kept)] = np.inf
        flat = every.reshape(len(starts) * k, -1)
        groups[k] = starts, np.vstack((-2 * flat.T, norms.reshape(1, -1)))
    shared = points.sparkSession.sparkContext.broadcast(groups)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = shared.value
        total = {k: np.zeros((m.shape[1], m.shape[0])) for k, (_, m) in groups.items()}
        for _, x in _pieces(frames, 2 * _ROWS):
            wide = np.hstack((x, np.ones((len(x), 1))))
            at = np.arange(len(x))[:, None]
            for k, (starts, m) in groups.items():
                label = (wide @ m).reshape(len(x), len(starts), k).argmin(axis=2)
                member = np.zeros((len(x), m.shape[1]))
                member[at, label + np.arange(len(starts)) * k] = 1
                total[k] += member.T @ wide
        yield pd.DataFrame({"k": list(total), "packed": [t.tobytes() for t in total.values()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": group["k"].iloc[:1], "packed": [_added(group["packed"])]})

    schema = "k int, packed binary"
    rows = _merged(points.mapInPandas(fold, schema), ["k"], add, schema,
                   points.rdd.getNumPartitions()).collect()
    shared.unpersist()
    found = {}
    for r in rows:
        starts, m = groups[r["k"]]
        every = np.frombuffer(r["packed"]).reshape(len(starts), r["k"], -1)
        found.update({(r["k"], s): t for s, t in zip(starts, every)})
    return found


def best_fits(df: DataFrame, key: str, ks: Iterable[int], starts: int = 100, features: str = "features",
              seed: int = 1, max_iter: int = 100, tol: float = 1e-12) -> dict[int, Fit]:
    """The best of ``starts`` runs for each k, by cost. A run ends when its centres move by ``tol`` at
    most (squared, in all), or after ``max_iter`` rounds. ``key`` is unique."""
    ks = sorted(set(ks))
    points = stored(df.select(F.xxhash64(key).alias("h"), _as_array(df, features).alias("v")), "points")
    if points.isEmpty():
        return {}
    seeds = _seeds(points, ks[-1], starts, seed)
    centres = {(k, s): seeds[s, :k] for k in ks for s in range(starts)}
    moving = set(centres)
    for _ in range(max_iter):
        if not moving:
            break
        for run, total in _rounds(points, {r: centres[r] for r in sorted(moving)}).items():
            size = total[:, -1:]
            new = np.where(size > 0, total[:, :-1] / np.maximum(size, 1), centres[run])
            if ((new - centres[run]) ** 2).sum() <= tol:
                moving.discard(run)
            centres[run] = new
    out: dict[int, Fit] = {}
    for (k, s), total in sorted(_sums(points, centres).items()):
        cost = float(total[:, 1].sum())
        if k not in out or cost < out[k].cost * (1 - 1e-12):
            out[k] = Fit(k, s, cost, centres[k, s], total[:, 0], total[:, 2], total[:, 3:])
    release(points)
    return out


def _nearest(centres: np.ndarray) -> Callable[[Column], Column]:
    @F.pandas_udf(IntegerType())
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(_squared(_matrix(v), centres).argmin(axis=1).astype("int32")) if len(v) else v
    return nearest


def kmeans(df: DataFrame, key: str, k: int, starts: int = 100, features: str = "features",
           seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows with ``cluster``, the centre at the least distance; centroids as (cluster, size, centroid
    array))."""
    spark = df.sparkSession
    fit = best_fits(df, key, [k], starts, features, seed).get(k)
    schema = "cluster int, size long, centroid array<double>"
    if fit is None:
        return df.withColumn("cluster", F.lit(None).cast("int")), spark.createDataFrame([], schema)
    rows = [(i, int(n), [float(x) for x in c]) for i, (n, c) in enumerate(zip(fit.sizes, fit.centres))]
    return df.withColumn("cluster", _nearest(fit.centres)(_as_array(df, features))), \
        spark.createDataFrame(rows, schema)


def _silhouettes(df: DataFrame, features: str, fits: dict[int, Fit]) -> dict[int, float]:
    """Mean silhouettes by squared distances. The mean squared distance of a row to a cluster follows
    from the cluster's size, squared norms and sum, so one pass is enough."""
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = {k: [0.0, 0] for k in fits}
        for frame in frames:
            x = _matrix(frame["v"])
            for k, fit in fits.items():
                if not len(x):
                    continue
                size = np.maximum(fit.sizes, 1)
                far = (x * x).sum(axis=1)[:, None] - 2 * x @ (fit.sums / size[:, None]).T \
                    + (fit.squares / size)[None, :]
                far = np.maximum(far, 0)
                label = _squared(x, fit.centres).argmin(axis=1)
                at = np.arange(len(x))
                own = fit.sizes[label]
                inner = far[at, label] * own / np.maximum(own - 1, 1)
                far[at, label] = np.inf
                far[:, fit.sizes == 0] = np.inf
                outer = far.min(axis=1)
                largest = np.maximum(inner, outer)
                known = (own > 1) & np.isfinite(outer) & (largest > 0)
                s = np.divide(outer - inner, largest, out=np.zeros(len(x)), where=known)
                out[k][0] += float(s.sum())
                out[k][1] += len(x)
        yield pd.DataFrame([(k, *v) for k, v in out.items()], columns=["k", "s", "n"])

    rows = df.select(_as_array(df, features).alias("v")).mapInPandas(fold, "k int, s double, n long") \
        .groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    return {r["k"]: r["s"] / r["n"] for r in rows if r["n"]}


def kmeans_sweep(df: DataFrame, key: str, ks: Iterable[int] = range(2, 51), starts: int = 100,
                 features: str = "features", seed: int = 1) -> DataFrame:
    """(k, silhouette_sq, sse) of the best start for each k."""
    fits = best_fits(df, key, ks, starts, features, seed)
    found = _silhouettes(df, features, fits) if fits else {}
    rows = [(k, found[k], fit.cost) for k, fit in sorted(fits.items())]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette_sq double, sse double")


def bisected_clusters(df: DataFrame, k: int, features: str = "features",
                      seed: int = 1) -> DataFrame:
    """Rows with ``cluster`` from top-down bisection into at most ``k`` leaves: coarse groups of more
    rows than complete linkage can compare."""
    held = df.persist()
    model = BisectingKMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster") \
        .fit(held)
    held.unpersist()
    return model.transform(df)


def projected_clusters(df: DataFrame, key: str, k: int = 10, starts: int = 100,
                       features: str = "features", seed: int = 1) -> DataFrame:
    """Rows with their first two components (``x``, ``y``), k-means ``cluster`` of the unreduced
    features and the first two coordinates of its centroid."""
    rows, centres = kmeans(pca(df, 2, features).projected, key, k, starts, features, seed)
    at = centres.select("cluster", F.col("centroid")[0].alias("centre_x"),
                        F.col("centroid")[1].alias("centre_y"))
    return rows.withColumns({"x": F.get("pca", F.lit(0)), "y": F.get("pca", F.lit(1))}).drop("pca") \
        .join(at, "cluster")
