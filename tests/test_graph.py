"""Graph operators against plain Python, with and without split hubs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagtrail.scale import durable
from tagtrail.operators import communities, components, graph, ranking
from tagtrail.schemas import EDGES

def make(spark, pairs, ids=None):
    ids = sorted({v for p in pairs for v in p} | set(ids or ()))
    vertices = spark.createDataFrame(
        [(i, f"t{i}", "1900", f"dept{i % 2}", str(i % 2), f"type{i % 3}", str(i % 3), str(i % 2),
          1) for i in ids],
        "id long, title string, date string, department string, department_id string, "
        "type string, type_id string, loan string, meta_store int")
    return vertices, spark.createDataFrame(pairs, EDGES)


def random_pairs(n, m, seed, hub=None):
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    if hub is not None:
        pairs |= {(hub, i) for i in range(n)}
    return sorted(pairs)


def test_vertices(spark):
    tags = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "refers_to_object_id long")
    objects = spark.createDataFrame(
        [(1, "A", "1900", "d1", "Print", "9", "0"), (2, "B", "1901", "d9", "poster", "8", None)],
        "id long, title string, date string, department_id string, type string, type_id string, "
        "is_loan_object string")
    departments = spark.createDataFrame([("d1", "Drawings")], "id string, name string")
    got = {r["id"]: (r["title"], r["department"], r["department_id"], r["loan"], r["meta_store"])
           for r in graph.graph_vertices(tags, objects, departments).collect()}
    assert got == {1: ("A", "Drawings", "d1", "0", 1), 2: ("B", "", "", "", 1),
                   3: ("", "", "", "", 0)}


@pytest.mark.usefixtures("joins")
def test_edges_need_metadata_at_both_ends(spark, rows):
    vertices, edges = make(spark, [(1, 1), (1, 2), (2, 3), (3, 1), (1, 4), (1, 5)])
    vertices = vertices.selectExpr("id", "CASE WHEN id = 3 THEN 0 ELSE 1 END AS meta_store")
    assert rows(graph.graph_edges(edges, vertices)) == [(1, 1), (1, 2), (1, 4), (1, 5)]


def test_degrees(spark, rows):
    _, edges = make(spark, [(1, 1), (1, 2), (2, 3)])
    assert rows(graph.in_degrees(edges)) == [(1, 1), (2, 1), (3, 1)]
    assert rows(graph.out_degrees(edges)) == [(1, 2), (2, 1)]
    assert rows(graph.degrees(edges)) == [(1, 3), (2, 2), (3, 1)]


def plain_pagerank(ids, pairs, rounds, reset=0.15):
    out = Counter(a for a, _ in pairs)
    rank = {i: 1.0 for i in ids}
    for _ in range(rounds):
        got = defaultdict(float)
        for a, b in pairs:
            got[b] += rank[a] / out[a]
        rank = {i: reset + (1 - reset) * got[i] for i in ids}
    return rank


@pytest.mark.usefixtures("joins")
def test_pagerank(spark):
    pairs = random_pairs(20, 50, 1, hub=3)
    vertices, edges = make(spark, pairs, ids=[99])
    ids = [r["id"] for r in vertices.collect()]
    got = {r["id"]: r["pagerank"] for r in ranking.pagerank(
        vertices, edges, iterations=7).collect()}
    assert got == pytest.approx(plain_pagerank(ids, pairs, 7))
    assert got[99] == pytest.approx(0.15)


def test_pagerank_to_tolerance(spark):
    pairs = random_pairs(15, 40, 2)
    vertices, edges = make(spark, pairs)
    ids = [r["id"] for r in vertices.collect()]
    got = {r["id"]: r["pagerank"] for r in ranking.pagerank(vertices, edges, tol=1e-4).collect()}
    assert got == pytest.approx(plain_pagerank(ids, pairs, 200), abs=1e-3)


def test_normalized_pagerank_sums_to_one(spark):
    _, edges = make(spark, [(1, 2), (2, 3), (4, 3), (1, 3)])
    got = ranking.pagerank_normalized(edges).collect()
    assert sum(r["pagerank"] for r in got) == pytest.approx(1)
    assert got[0]["id"] == 3


def test_tiers(spark):
    ranks = spark.createDataFrame([(1, 0.15), (2, 0.15), (3, 2.0), (4, 2.0), (5, 1.0)],
                                  "id long, pagerank double")
    assert [r["id"] for r in ranking.ranked(ranks, 2).collect()] == [3, 4]
    assert [r["id"] for r in ranking.ranked(ranks, 2, "bottom").collect()] == [2, 1]


def test_transitions(spark):
    vertices, edges = make(spark, [(1, 4), (2, 4), (3, 4), (5, 4), (4, 6)])
    ranks = ranking.pagerank(vertices, edges, iterations=3)
    got = ranking.transition_types(ranks, edges, "in", k=1).collect()
    top = ranking.ranked(ranks, 1).first()["id"]
    assert [r["influence_id"] for r in got] == [top]
    out = ranking.transition_types(ranks, edges, "out", k=10).collect()
    assert len(out) == 6


def plain_labels(ids, pairs, rounds):
    label = {i: i for i in ids}
    for _ in range(rounds):
        votes = defaultdict(Counter)
        for a, b in pairs:
            votes[a][label[b]] += 1
            votes[b][label[a]] += 1
        label = {i: min(votes[i], key=lambda v: (-votes[i][v], v)) if votes[i] else i
                 for i in ids}
    return label


@pytest.mark.usefixtures("joins")
@pytest.mark.parametrize("rounds", [1, 3, 6])
def test_label_propagation(spark, rounds):
    pairs = random_pairs(25, 40, 4, hub=2)
    vertices, edges = make(spark, pairs, ids=[77])
    ids = [r["id"] for r in vertices.collect()]
    got = {r["id"]: r["label"] for r in communities.label_propagation(
        vertices, edges, rounds).collect()}
    assert got == plain_labels(ids, pairs, rounds)


def reach(pairs, start):
    seen, todo = {start}, [start]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    while todo:
        for b in near[todo.pop()] - seen:
            seen.add(b)
            todo.append(b)
    return seen


@pytest.mark.usefixtures("joins")
def test_connected_components(spark):
    pairs = random_pairs(40, 25, 6) + [(100 + i, 101 + i) for i in range(20)]
    vertices, edges = make(spark, pairs, ids=[500])
    either = pairs + [(b, a) for a, b in pairs]
    got = {r["id"]: r["component"] for r in components.connected_components(
        vertices, edges).collect()}
    assert got == {i: min(reach(either, i)) for i in got}
    assert got[500] == 500 and got[120] == 100


def test_long_path_takes_few_even_rounds(spark, monkeypatch):
    ids = list(range(3000))
    random.Random(4).shuffle(ids)
    vertices, edges = make(spark, list(zip(ids, ids[1:])))
    marks, mark = [], components._mark
    monkeypatch.setattr(components, "_mark", lambda e: marks.append(e) or mark(e))
    got = components.connected_components(vertices, edges).select("component").distinct().collect()
    assert [r["component"] for r in got] == [0] and len(marks) < 40


@pytest.mark.usefixtures("joins")
def test_strongly_connected_components(spark):
    pairs = random_pairs(20, 30, 8) + [(50, 51), (51, 52), (52, 50), (52, 1)]
    vertices, edges = make(spark, pairs, ids=[70])
    got = {r["id"]: r["component"] for r in components.strongly_connected_components(
        vertices, edges).collect()}
    ahead = {i: reach(pairs, i) for i in got}
    assert got == {i: min(j for j in ahead[i] if i in ahead[j]) for i in got}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Exchange")


def test_a_round_shuffles_state_and_messages_but_no_edges(spark, monkeypatch):
    monkeypatch.setattr(graph.Adjacency, "SMALL", 0)
    vertices, edges = make(spark, random_pairs(300, 900, 3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        along = graph.Adjacency(edges)
        state = ranking.stored(ranking._with_out_degree(vertices, edges)
                               .withColumn("pagerank", F.lit(1.0)))
        sent = along.send(state, "pagerank")
        assert exchanges(sent) == (1, 1)
        plan = sent._jdf.queryExecution().executedPlan().toString()
        # What the exchange brings along is the state.
        assert plan.index("SelectedBucketsCount") < plan.index("Exchange hashpartitioning(src") \
            or "pagerank" in plan.split("Exchange hashpartitioning")[1]
        assert exchanges(ranking._round(along, state, 0.15, 0.85)) == (2, 2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_busy_sources_are_dealt_evenly(spark, monkeypatch):
    pairs = random_pairs(60, 150, 5, hub=7)
    vertices, edges = make(spark, pairs)
    plain = {r["id"]: r["pagerank"] for r in ranking.pagerank(vertices, edges, iterations=4).collect()}
    monkeypatch.setattr(graph.Adjacency, "BUSY", 10)
    monkeypatch.setattr(graph.Adjacency, "SMALL", 0)
    along = graph.Adjacency(edges)
    assert [r["src"] for r in along._busy.collect()] == [7]
    sent = along.send(vertices, "id", "value").collect()
    assert sorted((r["value"], r["dst"]) for r in sent) == sorted(pairs)
    split = {r["id"]: r["pagerank"] for r in ranking.pagerank(vertices, edges, iterations=4).collect()}
    assert split == pytest.approx(plain)


def slow_components(pairs, ids):
    """Strongly connected components by two depth-first passes."""
    out, back = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for i in ids:
        stack = [(i, iter(out[i]))] if i not in seen else []
        seen.add(i)
        while stack:
            at, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(stack.pop()[0])
            else:
                seen.add(step)
                stack.append((step, iter(out[step])))
    name = {}
    for i in reversed(order):
        if i in name:
            continue
        members, todo = [], [i]
        name[i] = i
        while todo:
            members.append(todo.pop())
            for x in back[members[-1]]:
                if x not in name:
                    name[x] = i
                    todo.append(x)
        name.update(dict.fromkeys(members, min(members)))
    return name


@pytest.mark.parametrize("kind", ["path", "cycle", "beads"])
def test_long_chains_take_few_rounds(spark, monkeypatch, kind):
    ids = list(range(10_000))
    random.Random(4).shuffle(ids)
    pairs = list(zip(ids, ids[1:]))
    if kind == "cycle":
        pairs.append((ids[-1], ids[0]))
    if kind == "beads":  # cycles joined by chains, with leaves
        pairs += [(ids[k + 100], ids[k]) for k in range(0, 9000, 300)]
        pairs += [(ids[k], 20_000 + k) for k in range(0, 9000, 450)]
    vertices, edges = make(spark, pairs)
    written, write = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name="table": written.append(name) or write(df, name))
    got = {r["id"]: r["component"] for r in components.strongly_connected_components(
        vertices, edges).select("id", "component").collect()}
    assert got == slow_components(pairs, sorted(got))
    assert written.count("chain") + written.count("state") < (100 if kind == "beads" else 60)


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = random_pairs(60, rng.choice((50, 70, 90, 140)), seed)
    chain = list(range(100, 130))  # a chain and a loop behind a random vertex
    pairs += [(rng.randrange(60), 100), (129, rng.randrange(60))] + list(zip(chain, chain[1:]))
    pairs += [(200, 201), (201, 202), (202, 200), (5, 300), (300, 5)]
    vertices, edges = make(spark, sorted(set(pairs)), ids=[70])
    got = {r["id"]: r["component"] for r in components.strongly_connected_components(
        vertices, edges).collect()}
    assert got == slow_components(pairs, sorted(got))


@pytest.mark.usefixtures("joins")
def test_triangles(spark):
    pairs = random_pairs(16, 60, 9, hub=0)
    vertices, edges = make(spark, pairs, ids=[90])
    plain = {frozenset(p) for p in pairs if p[0] != p[1]}
    ids = [r["id"] for r in vertices.collect()]
    want = Counter()
    for i, a in enumerate(ids):
        for j in range(i + 1, len(ids)):
            for c in ids[j + 1:]:
                if {frozenset((a, ids[j])), frozenset((ids[j], c)), frozenset((a, c))} <= plain:
                    want.update((a, ids[j], c))
    got = {r["id"]: r["count"] for r in components.triangle_count(vertices, edges).collect()}
    assert got == {i: want[i] for i in ids}


def test_reindex(spark, rows):
    _, edges = make(spark, [(10, 700), (700, 3), (3, 9000)])
    index = graph.vertex_reindex(edges)
    assert rows(index) == [(10, 1), (3, 0), (700, 2), (9000, 3)]
    assert rows(graph.reindexed_edges(edges, index)) == [(0, 3), (1, 2), (2, 0)]


@pytest.mark.usefixtures("joins")
def test_subgraph_drops_busy_sources(spark, rows):
    pairs = [(1, i) for i in range(10, 27)] + [(2, 10), (3, 40), (40, 2)]
    vertices, edges = make(spark, pairs)
    clusters = vertices.filter("id < 27").selectExpr("id", "department", "type", "loan",
                                                     "1L AS label")
    got = rows(communities.community_subgraph(edges, clusters))
    assert got == [(2, 10), (3, 40), (40, 2)]


def test_cluster_correlation_against_pandas(spark):
    vertices, _ = make(spark, [(i, i + 1) for i in range(40)])
    clusters = vertices.selectExpr("id", "department", "type", "loan", "id % 2 AS parity",
                                   "CASE WHEN id < 25 THEN 1L ELSE 2L END AS label")
    local = clusters.toPandas()
    got = {(r["label"], r["a"], r["b"]): r["corr"]
           for r in communities.cluster_type_correlation(clusters).collect()}
    import pandas as pd
    for label, part in local.groupby("label"):
        wide = pd.concat([pd.get_dummies(part["department"], prefix="dept"),
                          pd.get_dummies(part["type"], prefix="type")], axis=1).astype(float)
        matrix = wide.corr()
        assert len([k for k in got if k[0] == label]) == matrix.size
        for a in matrix:
            for b in matrix:
                assert got[label, a, b] == pytest.approx(matrix.loc[a, b])


def test_profiles_count_each_tag_once(spark, rows):
    vertices, _ = make(spark, [(1, 2), (3, 4)])
    clusters = vertices.selectExpr("id", "department", "type", "loan", "id % 2 AS label")
    tags = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 1, 1), (2, 1, 0), (9, 1, 0)],
                                 "refers_to_object_id long, during_exhibition int, "
                                 "tagged_after_close int")
    places = spark.createDataFrame([(1, "201"), (1, "201"), (3, "202")], "id long, room_name string")
    got = communities.cluster_profiles(tags, places, clusters)
    assert rows(got["exhibitions"]) == [(0, 1, 1), (1, 0, 1), (1, 1, 2)]
    assert rows(got["departments"]) == [(0, "dept0", 1), (1, "dept1", 3)]
    assert rows(got["rooms"]) == [(1, "201", 2), (1, "202", 1)]


def test_label_propagation_writes_each_edge_once_before_it_is_dealt(spark, monkeypatch):
    pairs = [(i, (i * 7 + 3) % 40) for i in range(40)] + [(i, (i + 1) % 40) for i in range(40)]
    pairs = sorted({p for p in pairs if p[0] != p[1]})
    vertices = spark.range(40)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    plain = {tuple(r) for r in communities.label_propagation(vertices, edges, 7).collect()}
    rows = []

    def kept(df, name="table"):
        out = durable.stored(df, name)
        if name == "edges":
            rows.append(out.count())
        return out
    monkeypatch.setattr(graph.Adjacency, "SMALL", 0)
    for module in (graph, communities):
        monkeypatch.setattr(module, "stored", kept)
    dealt = {tuple(r) for r in communities.label_propagation(vertices, edges, 7).collect()}
    assert rows == [len(pairs)] and dealt == plain


@pytest.mark.parametrize("least, hub", [(0, None), (-7, None), (1 << 40, None), (0, 5)])
def test_label_propagation_sends_all_labels_in_few_rounds(spark, monkeypatch, least, hub):
    pairs = [(a + 10 * k, b + 10 * k) for k in range(4) for a in range(10) for b in range(a)]
    pairs += [(9, 10), (19, 20), (29, 30)] + [(40 + i, 41 + i) for i in range(12)]
    pairs += [(hub, i) for i in range(20, 40)] if hub is not None else []
    pairs = sorted({(a + least, b + least) for a, b in pairs})
    vertices, edges = make(spark, pairs, ids=[least + 99])
    ids = [r["id"] for r in vertices.collect()]
    monkeypatch.setattr(graph.Adjacency, "SMALL", 0)
    if hub is not None:
        monkeypatch.setattr(graph.Adjacency, "BUSY", 25)
    sent, rounds = [], []
    send, elected = graph.Adjacency.send, communities._elected
    monkeypatch.setattr(graph.Adjacency, "send", lambda self, state, value, name="value":
                        sent.append(value) or send(self, state, value, name))
    monkeypatch.setattr(communities, "_elected", lambda state, votes, packs:
                        rounds.append(packs) or elected(state, votes, packs))
    got = {r["id"]: r["label"] for r in communities.label_propagation(vertices, edges, 30).collect()}
    assert got == plain_labels(ids, pairs, 30)
    assert len(sent) == len(rounds) - 1 and sent.count("label") < len(rounds) / 2
    assert set(rounds) == {least == 0}


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_label_propagation_with_repeated_and_unknown_vertices(spark, monkeypatch, small):
    monkeypatch.setattr(graph.Adjacency, "SMALL", small)
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6), (None, 6)], EDGES)

    def labels(ids, rounds):
        vertices = spark.createDataFrame([(i,) for i in ids], "id long")
        return sorted(tuple(r) for r in communities.label_propagation(vertices, edges, rounds).collect())
    # The vertex listed twice has two votes in the first round; 4 is no vertex and has none.
    assert labels([1, 2, 3, 3, 5, 6], 1) == [(1, 2), (2, 3), (3, 2), (3, 2), (5, 6), (6, 5)]


def test_votes_are_counted_without_sorting(spark, monkeypatch):
    monkeypatch.setattr(graph.Adjacency, "SMALL", 0)
    vertices, edges = make(spark, random_pairs(300, 900, 3))
    along = graph.Adjacency(graph.both_ways(edges))
    state = communities.stored(vertices.selectExpr("id", "id AS label", "CAST(NULL AS BIGINT) AS before"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(along.counted()) == (0, 0)  # edges are counted where they lie
        votes = communities._votes(along, state, True)
        assert exchanges(votes)[1] == 2  # the state, the messages
        monkeypatch.setattr(communities, "stored", lambda df, name: df)
        plan = communities._elected(state, votes, True)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "Sort [" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_values_are_sent_once_after_they_fell(spark, monkeypatch, small):
    monkeypatch.setattr(graph.Adjacency, "SMALL", small)
    n = 40
    pairs = sorted({(i, (i * k + 1) % n) for i in range(n) for k in (1, 7, 11)} - {(i, i) for i in range(n)})
    vertices, edges = make(spark, pairs, ids=[99])
    sent, passes, made = [], [], []
    send, spread, adjacency = graph.Adjacency.send, components._spread_min, graph.Adjacency.__init__

    def counted(self, state, value, name="value"):
        sent[-1].append(state.count())
        return send(self, state, value, name)
    monkeypatch.setattr(graph.Adjacency, "send", counted)
    monkeypatch.setattr(graph.Adjacency, "__init__", lambda self, edges, written=False:
                        made.append(written) or adjacency(self, edges, written))
    monkeypatch.setattr(components, "_spread_min", lambda *args: sent.append([]) or spread(*args))
    got = {r["id"]: r["component"] for r in components.strongly_connected_components(
        vertices, edges).collect()}
    assert got == slow_components(pairs, sorted(got))
    down, back = sent[:2]
    assert down[0] == n and sum(down[1:]) < n * (len(down) - 1)
    assert back[0] == 1 and sum(back) == n  # each vertex is reached once
    assert all(made)  # edges that are written already are not written again before they are dealt


def test_strong_components_with_unknown_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 9), (9, 4), (4, 5), (5, 4), (4, 9)], EDGES)
    vertices = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "id long")
    got = sorted(tuple(r) for r in components.strongly_connected_components(vertices, edges).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
