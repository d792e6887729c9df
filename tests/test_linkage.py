"""Dendrograms, samples, ranks and metadata similarity against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from tagtrail.operators import linkage, metadata, selection
from tagtrail.scale import durable

SCHEMA = "id long, kind string, place string, flag int"


def table(spark, n, kinds, places, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice((None, *map(str, range(kinds)))), str(rng.randrange(places)),
             rng.randrange(2)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def sets(rows):
    return {i: frozenset(x for x in (k and f"kind={k}", f"place={p}", "flag" if f else None) if x)
            for i, k, p, f in rows}


def slow_distance(a, b, metric, width):
    differ, both = len(a ^ b), len(a & b)
    if metric == "cityblock":
        return float(differ)
    if metric == "hamming":
        return differ / width
    if metric == "jaccard":
        return differ / (differ + both)
    return 1 - both / math.sqrt(len(a) * len(b))


def slow_merges(names, distance):
    """Merge the nearest two clusters over and over, by all distances of their members."""
    def key(i, j):
        return (distance[i, j], (i * 7919 + j * 104729 + i * j % 65521 * 31) % 1000003, i, j)
    clusters = {i: [i] for i in names}
    out = []
    while len(clusters) > 1:
        nearest = min((max(key(min(i, j), max(i, j)) for i in clusters[a] for j in clusters[b]), a, b)
                      for a, b in itertools.combinations(sorted(clusters), 2))
        (height, *_), a, b = nearest
        out.append((a, b, height))
        clusters[a] = clusters[a] + clusters.pop(b)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_merges_are_those_of_the_brute_force_dendrogram(spark, seed):
    df, rows = table(spark, 70, 4, 5, seed)
    of_row = sets(rows)
    names, counts = {}, {}
    for i in sorted(of_row):
        names.setdefault(of_row[i], i)
        counts[names[of_row[i]]] = counts.get(names[of_row[i]], 0) + 1
    level = {i: s for s, i in names.items()}
    width = len(set().union(*level.values()))
    found = durable.stored(linkage.profiles(df, "id", ["kind", "place"], ["flag"]))
    assert {r["id"]: (r["n"], frozenset(r["levels"])) for r in found.collect()} == \
        {i: (counts[i], level[i]) for i in level}
    pairs = durable.stored(linkage.profile_pairs(found))
    merges = durable.stored(linkage.complete_linkage(pairs))
    figures = {r["metric"]: r["correlation"]
               for r in linkage.cophenetic_correlation(found, pairs, merges).collect()}
    for metric in linkage.METRICS:
        distance = {(i, j): slow_distance(level[i], level[j], metric, width)
                    for i, j in itertools.combinations(sorted(level), 2)}
        truth = slow_merges(level, distance)
        got = {(r["a"], r["b"]): r["height"] for r in merges.where(f"metric = '{metric}'").collect()}
        assert got == pytest.approx({(a, b): h for a, b, h in truth})
        # Cophenetic distances of all pairs of rows.
        at, coph = {i: {i} for i in level}, {}
        for a, b, h in truth:
            coph.update({(min(i, j), max(i, j)): h for i in at[a] for j in at[b]})
            at[a] |= at.pop(b)
        x, y = [], []
        for i, j in itertools.combinations(range(len(rows)), 2):
            p, q = sorted((names[of_row[i]], names[of_row[j]]))
            x.append(0.0 if p == q else distance[p, q])
            y.append(0.0 if p == q else coph[p, q])
        assert figures[metric] == pytest.approx(np.corrcoef(x, y)[0, 1])
    # Flat clusters: pairs of rows that meet at 0.6 of the top or below.
    distance = {(i, j): slow_distance(level[i], level[j], "cityblock", width)
                for i, j in itertools.combinations(sorted(level), 2)}
    at, top = {i: {i} for i in level}, max(h for *_, h in slow_merges(level, distance))
    for a, b, h in slow_merges(level, distance):
        if h <= 0.6 * top:
            at[a] |= at.pop(b)
    clusters = linkage.flat_clusters(found, merges.where("metric = 'cityblock'"))
    got = {r["id"]: r["cluster"] for r in linkage.row_clusters(
        df, "id", ["kind", "place"], ["flag"], found, clusters).collect()}
    assert got == {i: next(min(c) for c in at.values() if names[of_row[i]] in c) for i in of_row}


def test_equal_distances_take_few_rounds(spark, monkeypatch):
    rows = [(i, str(i), "a", 0) for i in range(400)]  # every two are equally far apart
    found = durable.stored(linkage.profiles(spark.createDataFrame(rows, SCHEMA), "id", ["kind"]))
    made = []
    monkeypatch.setattr(linkage, "stored", lambda df, name="table": (
        made.append(name), durable.stored(df, name))[1])
    merges = linkage.complete_linkage(linkage.profile_pairs(found, ["cityblock"]))
    assert merges.count() == 399 and made.count("merged") < 40


def test_a_round_sends_numbers_of_fixed_width(spark, monkeypatch):
    df, _ = table(spark, 60, 5, 7, 3)
    found = durable.stored(linkage.profiles(df, "id", ["kind", "place"], ["flag"]))
    plans = []

    def kept(df, name="table"):
        if name == "linkage":
            plans.append((df._jdf.queryExecution().toString(), df.schema))
        return durable.stored(df, name)
    monkeypatch.setattr(linkage, "stored", kept)
    assert linkage.complete_linkage(linkage.profile_pairs(found, ["cosine"])).count() > 0
    for plan, schema in plans:
        # No sorted groups, no join that deals the pairs anew.
        assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
        assert all(f.dataType.simpleString() in ("int", "bigint", "double") for f in schema)


def test_linkage_of_one_profile_and_of_none(spark):
    for rows in ([(1, "a", "b", 0), (2, "a", "b", 0)], []):
        found = durable.stored(linkage.profiles(spark.createDataFrame(rows, SCHEMA), "id", ["kind"]))
        pairs = durable.stored(linkage.profile_pairs(found))
        merges = linkage.complete_linkage(pairs)
        assert merges.count() == 0 and linkage.cophenetic_correlation(found, pairs, merges).count() == 0
        assert [tuple(r) for r in linkage.flat_clusters(found, merges).collect()] == \
            [(1, 1)] * bool(rows)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_object_similarity(spark, n, joins):
    rng = random.Random(n)
    rows = [(i, rng.choice((None, "x", "y", "a,\"b", "z")), rng.choice((None, "1", "2")),
             rng.choice((None, *"pqrstu"))) for i in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    truth = set()
    for i, *mine in rows:
        near = []
        for j, *other in rows:
            shared = sum(x is not None and x == y for x, y in zip(mine, other))
            if i != j and shared:
                size = sum(x is not None for x in mine) * sum(x is not None for x in other)
                near.append((-round(shared / math.sqrt(size), 9), j))
        truth |= {(i, j, -s) for s, j in sorted(near)[:n]}
    got = {(r["id"], r["other"], round(r["similarity"], 9)) for r in
           metadata.object_similarity(df.repartition(7), "id", ["a", "b", "c"], n).collect()}
    assert got == truth


def test_object_similarity_of_one_large_profile(spark):
    df = spark.range(3000).selectExpr("id", "'same' AS a", "CAST(NULL AS STRING) AS b")
    got = metadata.object_similarity(df, "id", ["a", "b"], 2)
    assert got.count() == 6000
    assert {tuple(r) for r in got.where("id IN (0, 2999)").collect()} == \
        {(0, 1, 1.0), (0, 2, 1.0), (2999, 0, 1.0), (2999, 1, 1.0)}
    assert metadata.object_similarity(df.limit(0), "id", ["a", "b"]).count() == 0


def test_ranks_of_many_distinct_values(spark):
    df = spark.range(1_000_000).selectExpr("(id * 7919) % 1000003 AS x", "id") \
        .union(spark.range(100_000).selectExpr("0 AS x", "id")) \
        .union(spark.range(1).selectExpr("CAST(NULL AS BIGINT) AS x", "id"))
    distinct = np.unique((np.arange(1_000_000) * 7919) % 1000003)
    percents = [0, 12.5, 50, 70, 95, 100]
    got = selection.distinct_percentiles(df, "x", percents, skip=1)
    assert got == pytest.approx([np.percentile(distinct[1:], p) for p in percents])
    assert selection.distinct_percentiles(df.where("x = 0"), "x", [50], skip=1) == [None]
    ranked = selection.Ranked(df, "x")
    assert ranked.count == 1_100_000 and ranked.at([0, 100_000, 100_001]) == {
        0: 0, 100_000: 0, 100_001: int(distinct[1])}
    with pytest.raises(IndexError):
        ranked.at([1_100_000])


def test_sampled_rows(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS g")
    sizes = {n: {r["id"] for r in selection.sampled_rows(df, "id", rows=n).collect()}
             for n in (1, 50, 500, 5000, 9000)}
    assert {n: len(s) for n, s in sizes.items()} == {1: 1, 50: 50, 500: 500, 5000: 5000, 9000: 5000}
    assert sizes[1] < sizes[50] < sizes[500]
    again = selection.sampled_rows(df.repartition(11), "id", fraction=0.1)
    assert {r["id"] for r in again.collect()} == sizes[500]
    assert {r["id"] for r in selection.sampled_rows(df, "id", rows=500, salt="b").collect()} != sizes[500]
    assert selection.sampled_rows(df, "id", rows=0).count() == 0
    assert selection.sampled_rows(df.limit(0), "id", fraction=0.5).count() == 0
    # Every group has its share: 500 of 5000 over 7 groups.
    count = np.bincount([i % 7 for i in sizes[500]])
    assert count.min() > 40 and count.max() < 105


def test_release_removes_what_was_stored(spark):
    table = durable.stored(spark.range(5), "gone")
    path = table._scratch
    durable.release(table)
    durable.release(table)  # once more does nothing
    durable.release(spark.range(3))
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
