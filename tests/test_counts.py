"""Votes counted with numpy, journeys from packed tags, edges between known vertices, busy sources by slots."""

from collections import Counter

import numpy as np
import pytest

from tagtrail.operators import communities, graph, journeys

TAGS = "id long, tool_id int, bundle_id string, refers_to_object_id long, created long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [0, -3, 1 << 33])
def test_tallied(least):
    rng = np.random.default_rng(5)
    dst, label = rng.integers(0, 9, 300) + least, rng.integers(0, 6, 300) + least
    votes = Counter(zip(dst.tolist(), label.tolist()))
    assert list(zip(*(c.tolist() for c in communities.tallied(dst, label, True)))) \
        == [(*k, n) for k, n in sorted(votes.items())]
    best = {}
    for (d, v), n in sorted(votes.items()):
        if n > best.get(d, (0, 0))[1]:
            best[d] = v, n
    assert list(zip(*(c.tolist() for c in communities.tallied(dst, label, False)))) \
        == [(d, *best[d]) for d in sorted(best)]
    none = np.array([], np.int64)
    assert [c.size for c in communities.tallied(none, none, False)] == [0, 0, 0]


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_votes_are_counted_with_numpy(spark, monkeypatch, rows, small):
    monkeypatch.setattr(graph.Adjacency, "SMALL", small)
    edges = spark.createDataFrame([(i, i * i % 23) for i in range(40)], "src long, dst long")
    along = graph.Adjacency(graph.both_ways(edges))
    state = communities.stored(spark.range(40).selectExpr("id", "id % 4 AS label"))
    votes = communities._votes(along, state, True)
    assert "MapInArrow" in plan(votes)
    assert rows(votes) == rows(along.send(state, "label", "label").groupBy("dst", "label").count())
    assert communities._votes(along, state, True, False).groupBy("dst").count().where("count > 1").isEmpty()


def test_packed_journeys_are_not_sorted_first(spark, rows):
    tags = spark.createDataFrame([(1, 0, "a", 5, 60), (3, 0, "a", 7, 60), (3, 0, "a", 6, 60), (2, 0, "a", 9, 60),
                                  (4, 0, "a", 8, 61), (4, 0, "a", 8, 61), (5, 1, "a", 4, 62), (6, 0, "b", 0, 1),
                                  (7, 0, None, 3, 1), (8, 0, "b", None, 2), (9, 0, "b", 2, None)], TAGS)
    bits = journeys.packing(tags)
    assert bits == 4
    packed = journeys.journey_steps(tags, bits)
    assert rows(packed) == rows(journeys.journey_steps(tags)) and packed.schema == journeys.journey_steps(tags).schema
    assert "SortAggregate" not in plan(packed)
    assert rows(graph.all_edges(tags, written=True)) == rows(graph.all_edges(tags)) == [(7, 8)]


@pytest.mark.parametrize("odd", [(None, 5), (-1, 5), (1, -5), (1 << 50, 1 << 20)])
def test_ids_that_cannot_be_packed(spark, rows, odd):
    tags = spark.createDataFrame([(1, 0, "a", 5, 60), (odd[0], 0, "a", odd[1], 60), (2, 0, "a", 3, 61)], TAGS)
    assert journeys.packing(tags) is None
    assert rows(graph.all_edges(tags, written=True)) == rows(graph.all_edges(tags))
    assert journeys.packing(tags.limit(0)) is None


def test_edges_of_known_vertices(spark, rows):
    vertices = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1)], "id long, meta_store int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "src long, dst long")
    got = graph.graph_edges(edges, vertices, known=True)
    assert rows(got) == rows(graph.graph_edges(edges, vertices)) == [(1, 2), (4, 4)]
    assert "LeftAnti" in plan(got)


@pytest.mark.parametrize("slots", [1, 3, 1 << 16])
def test_busy_sources_by_slots(spark, monkeypatch, rows, slots):
    monkeypatch.setattr(graph, "SLOTS", slots)
    edges = spark.createDataFrame([(s, d) for s in range(12) for d in range(s)], "src long, dst long")
    assert rows(graph._frequent(edges, 8)) == [(10,), (11,), (9,)]
    assert rows(graph._frequent(edges, 100)) == []
