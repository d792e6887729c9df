"""Correlations, variance, distances, PCA and clustering."""

import numpy as np
import pandas as pd
import pytest

from tagtrail.operators import clustering, similarity, statistics


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(90, 5)) + np.repeat(np.eye(3, 5) * 6, 30, axis=0)
    local = pd.DataFrame(base, columns=list("abcde"))
    local["cluster"] = np.repeat([0, 1, 2], 30)
    local["id"] = range(90)
    local["v"] = list(base)
    return local, spark.createDataFrame(local).cache()


def test_target_correlation(points):
    local, df = points
    want = local[list("abcde")].corr()["b"].sort_values(ascending=False)
    got = statistics.target_correlation(df, "b", list("abcde"), 3).collect()
    assert [r["feature"] for r in got] == list(want.index[:3])
    assert [r["corr"] for r in got] == pytest.approx(list(want[:3]))


def test_constant_columns_come_last(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, 1.0, 1.0)], "t double, k double, n double")
    got = statistics.target_correlation(df, "t", ["k", "n", "t"]).collect()
    assert [r["feature"] for r in got] == ["t", "n", "k"]
    assert [r["corr"] for r in got[:2]] == pytest.approx([1, -1]) and got[2]["corr"] is None


def test_cluster_target_correlation(points):
    local, df = points
    got = statistics.cluster_target_correlation(df, "a", list("abcde"), k=2).collect()
    for c, part in local.groupby("cluster"):
        want = part[list("abcde")].corr()["a"].sort_values(ascending=False)[:2]
        mine = [r for r in got if r["cluster"] == c]
        assert [r["feature"] for r in mine] == list(want.index)
        assert [r["corr"] for r in mine] == pytest.approx(list(want))
        assert mine[0]["share"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("scale", [False, True])
def test_feature_profile(points, scale):
    local, df = points
    x = local[list("abcde")]
    if scale:
        x = (x - x.mean()) / x.std(ddof=0)
    got = statistics.cluster_feature_profile(df, list("abcde"), k=3, scale=scale).collect()
    for c in range(3):
        means = x[local["cluster"] == c].mean()
        want = means[means.astype(int) != 1].sort_values(ascending=False)[:3]
        mine = [r for r in got if r["cluster"] == c]
        assert [r["mean"] for r in sorted(mine, key=lambda r: -r["mean"])] == \
            pytest.approx(list(want))


def test_cluster_variance(points):
    local, df = points
    x = np.vstack(local["v"])
    labels = local["cluster"].to_numpy()
    wcss = sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in range(3))
    tss = ((x - x.mean(axis=0)) ** 2).sum()
    got = dict(statistics.cluster_variance(clustering.from_array(df, "v")).collect())
    assert got == pytest.approx({"wcss": wcss, "tss": tss, "bss": tss - wcss})


@pytest.mark.parametrize("block_rows", [10, 2048])
@pytest.mark.parametrize("metric", ["cityblock", "euclidean", "cosine", "hamming", "jaccard"])
def test_pairwise_distance(spark, metric, block_rows):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, size=(25, 6)).astype(float)
    x[0] = 0
    x[1] = 0
    if metric == "cosine":
        x += 1
    df = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)],
                               "id long, v array<double>")
    got = {(r["a"], r["b"]): r["distance"]
           for r in similarity.pairwise_distance(df, "id", "v", metric, block_rows).collect()}

    def plain(p, q):
        either = ((p != 0) | (q != 0)).sum()
        return {"cityblock": abs(p - q).sum(), "euclidean": np.sqrt(((p - q) ** 2).sum()),
                "cosine": 1 - p @ q / max(np.linalg.norm(p) * np.linalg.norm(q), 1e-300),
                "hamming": (p != q).mean(),
                "jaccard": (p != q).sum() / either if either else 0.0}[metric]

    want = {(i, j): plain(x[i], x[j]) for i in range(25) for j in range(i + 1, 25)}
    assert got == pytest.approx(want)
    to = {(r["a"], r["b"]): r["distance"]
          for r in similarity.reference_distance(df, "id", "v", [3, 7], metric).collect()}
    assert to == pytest.approx({(i, j): plain(x[i], x[j]) for i in (3, 7) for j in range(25)
                                if i != j})


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_cosine_similarity(points, block_rows):
    local, df = points
    x = np.vstack(local["v"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    got = similarity.cosine_similarity(df, "id", "v", 4, block_rows).collect()
    assert len(got) == 360
    for i in (0, 41, 89):
        mine = sorted((r for r in got if r["id"] == i), key=lambda r: -r["similarity"])
        assert [r["other"] for r in mine] == list(np.argsort(-sims[i])[:4])


def test_pca(points):
    local, df = points
    x = np.vstack(local["v"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z)
    order = np.argsort(-values)
    vectors = vectors[:, order[:2]]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), [0, 1]])
    for parts in (1, 7, 40):  # 40 triangles are reduced in two steps
        found = clustering.pca(clustering.from_array(df.repartition(parts), "v"), 2)
        assert found.ratios == pytest.approx(list(values[order][:2] / values.sum()))
        mine = np.array([r["pca"] for r in found.projected.orderBy("id").collect()])
        assert mine == pytest.approx(z @ vectors) and found.loadings == pytest.approx(vectors.T)


def test_pca_of_constant_and_dependent_features(spark):
    rows = [(i, [float(i), 2.0 * i, 5.1, float(i % 3)]) for i in range(12)]
    df = clustering.from_array(spark.createDataFrame(rows, "id long, v array<double>"), "v")
    found = clustering.pca(df, 4)
    assert sum(found.ratios) == pytest.approx(1) and found.ratios[2:] == pytest.approx([0, 0])
    assert np.isfinite([r["pca"] for r in found.projected.collect()]).all()


def test_scree(points):
    got = clustering.scree(clustering.from_array(points[1], "v"), 5).orderBy("component").collect()
    assert [r["component"] for r in got] == [0, 1, 2, 3, 4, 5]
    ratios = [r["ratio"] for r in got]
    assert ratios[0] == 0 and ratios[1:] == sorted(ratios[1:], reverse=True)
    assert got[-1]["cumulative"] == pytest.approx(1)


def slow_kmeans(keys, x, k, starts, seed):
    """Seeding and rounds of each start by itself, with loops; the best centres and cost."""
    best = None
    for s in range(starts):
        centres = []
        for place in range(k):
            u = clustering.uniform(keys, starts, place, seed)[:, s]
            near = [min((((p - c) ** 2).sum() for c in centres), default=1.0) for p in x]
            times = [-np.log(a) / d if d > 1e-9 else np.inf for a, d in zip(u, near)]
            centres.append(x[int(np.argmin(times))])
        while True:
            label = [int(np.argmin([((p - c) ** 2).sum() for c in centres])) for p in x]
            new = [np.mean([p for p, m in zip(x, label) if m == i], axis=0) if i in label
                   else centres[i] for i in range(k)]
            done = np.allclose(new, centres, atol=1e-9)
            centres = new
            if done:
                break
        cost = sum(((p - centres[m]) ** 2).sum() for p, m in zip(x, label))
        if best is None or cost < best[0] * (1 - 1e-12):
            best = cost, np.array(centres), np.array(label)
    return best


def slow_silhouette(x, label):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = []
    for i, m in enumerate(label):
        if (label == m).sum() == 1:
            out.append(0.0)
            continue
        a = d[i, label == m].sum() / ((label == m).sum() - 1)
        b = min(d[i, label == o].mean() for o in set(label) - {m})
        out.append((b - a) / max(a, b))
    return np.mean(out)


@pytest.mark.parametrize("parts", [5, 70])
def test_kmeans_against_one_start_at_a_time(spark, points, parts):
    local, df = points
    vectors = clustering.from_array(df.drop("cluster").repartition(parts), "v")
    x = np.vstack(local["v"])
    hashed = spark.range(90).selectExpr("xxhash64(id) AS h").collect()
    keys = np.array([r["h"] for r in hashed])
    sweep = {r["k"]: r for r in clustering.kmeans_sweep(vectors, "id", [2, 3, 5], starts=4).collect()}
    for k in (2, 3, 5):
        cost, centres, label = slow_kmeans(keys, x, k, 4, 1)
        assert sweep[k]["sse"] == pytest.approx(cost)
        assert sweep[k]["silhouette_sq"] == pytest.approx(slow_silhouette(x, label))
        rows, found = clustering.kmeans(vectors, "id", k, starts=4)
        found = found.orderBy("cluster").collect()
        assert np.array([r["centroid"] for r in found]) == pytest.approx(centres)
        assert [r["cluster"] for r in rows.orderBy("id").collect()] == list(label)
        assert [r["size"] for r in found] == list(np.bincount(label, minlength=k))


def test_kmeans_with_fewer_distinct_rows_than_clusters(spark):
    rows = [(i, [float(i % 2), 1.0]) for i in range(10)]
    df = clustering.from_array(spark.createDataFrame(rows, "id long, v array<double>"), "v")
    found, centres = clustering.kmeans(df, "id", 4, starts=3)
    assert sorted(r["size"] for r in centres.collect()) == [0, 0, 5, 5]
    assert found.select("cluster").distinct().count() == 2
    assert clustering.kmeans(df.limit(0), "id", 2)[1].count() == 0


def test_seeds_are_drawn_by_squared_distance():
    x = np.array([[0.0], [1.0], [3.0]])
    chosen = np.zeros((20_000, 1, 1))  # the first row is the first seed of every start
    times = clustering.race(np.array([5, 6, 7]), x, chosen, 1)
    assert not np.isfinite(times[0]).any()
    assert (times.argmin(axis=0) == 2).mean() == pytest.approx(0.9, abs=0.01)


def test_bisecting_and_projected_clusters(points):
    vectors = clustering.from_array(points[1].drop("cluster"), "v")
    assert clustering.bisected_clusters(vectors, 3).select("cluster").distinct().count() == 3
    shown = clustering.projected_clusters(vectors, "id", 3, starts=2)
    assert shown.count() == 90 and {"x", "y", "centre_x", "centre_y"} <= set(shown.columns)
    sizes = shown.groupBy("cluster").count().collect()
    assert [r["count"] for r in sizes] == [30, 30, 30]


def test_rounds_of_kmeans_give_sizes_and_sums_of_the_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                   "h long, v array<double>").repartition(3)
    centres = {(k, s): rng.normal(size=(k, 6)) for k in (2, 5, 9) for s in (0, 1, 4)}
    centres[5, 1][3] = centres[5, 1][1]  # the later of two equal centres stays empty
    found = clustering._rounds(points, centres)
    assert set(found) == set(centres)
    for run, c in centres.items():
        label = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(len(c)):
            assert found[run][j, -1] == (label == j).sum()
            assert np.allclose(found[run][j, :-1], x[label == j].sum(axis=0))
    assert found[5, 1][3, -1] == 0 < found[5, 1][1, -1]
