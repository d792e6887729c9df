"""What steps gather, sort and send, on tables whose steps once grew too large."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtrail.functions import calendar as cal
from tagtrail.operators import communities, graph, locations, metadata, similarity
from tagtrail.plans.model_views import Views


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_tiles_give_the_nearest_of_all(monkeypatch, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    rng = np.random.default_rng(tile)
    x = rng.integers(-1, 2, (40, 4)).astype(float)
    x[5] = np.nan
    names = np.arange(40) * 2
    got = {}
    for row, other, product in zip(*similarity.best_others(names, x, names, x, 6)):
        got.setdefault(int(row), []).append((int(other), float(product)))
    for i in range(40):
        all_ = sorted((-float(x[i] @ x[j]), 2 * j) for j in range(40) if j != i and 5 not in (i, j))
        assert got.get(2 * i, []) == [(j, -s) for s, j in all_[:6]]


def test_single_floats_are_sent_as_they_are(spark):
    df = spark.range(3).selectExpr("id", "array(CAST(1 AS FLOAT), CAST(id AS FLOAT)) AS v")
    dealt = similarity._dealt(df, "id", "v", 1, df.schema["v"].dataType)
    assert dealt.schema["v"].dataType.simpleString() == "array<float>"


def test_only_the_first_of_a_profile_are_indexed(spark, monkeypatch):
    seen, plain = [], metadata._combinations
    monkeypatch.setattr(metadata, "_combinations",
                        lambda rows, *rest: seen.append(rows.count()) or plain(rows, *rest))
    df = spark.range(500).selectExpr("id", "'same' AS a", "CAST(id % 2 AS STRING) AS b")
    assert metadata.object_similarity(df, "id", ["a", "b"], 3).count() == 1500
    assert seen == [8, 2]


@pytest.fixture
def views(spark, tmp_path):
    tables = {
        "supplier": ([(1, "s1", 7), (2, "s2", 8), (2, "s2", 8), (2, "other", 7), (3, "s3", 7),
                      (None, "s4", 7)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(7, 0), (8, 1)], "n_nationkey int, n_regionkey int"),
        "region": ([(0,), (1,)], "r_regionkey int"),
        "lineitem": ([(1, 1, 10, 1), (1, 2, 10, 1), (2, 1, 11, 1), (2, 2, 10, 2), (3, 1, None, 2),
                      (4, 1, 12, None), (4, 2, 13, 9)],
                     "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"),
        "orders": ([(i, 5) for i in range(1, 5)], "o_orderkey long, o_custkey long"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        for key, at in (("l_orderkey", "l_shipdate"), ("o_orderkey", "o_orderdate")):
            if key in df.columns:
                df = df.withColumn(at, F.lit("2024-01-02").cast("timestamp_ntz"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return Views(spark, str(tmp_path))


def test_spots_are_counted_on_keys(views, rows):
    columns = ["id", "name", "description", "count_objects"]
    assert rows(views.spots, *columns) == rows(Views._spots(views.visits), *columns)
    counted = [line for line in plan(views.spots).splitlines() if "Aggregate" in line and "l_partkey" in line]
    assert counted and not any("s_name" in line for line in counted)


def test_baskets_are_joined_once(views):
    assert "Join" not in plan(views.baskets)
    assert views.baskets.count() == 7


def test_visits_of_untagged_objects_go_first(spark):
    schema = "refers_to_object_id long, visit_raw long, spot_id long"
    visits = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (None, 0, 1)], schema)
    tags = spark.createDataFrame([(1, 86400), (None, 0)], "refers_to_object_id long, created long")
    found = locations.nearest_by_day(tags, visits)
    assert [(r["refers_to_object_id"], r["spot_id"]) for r in found.collect()] == [(1, 1)]
    assert "LeftSemi" in plan(found)


def test_rooms_are_counted_for_members_only(spark, rows):
    places = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "id long, room_name string")
    clusters = spark.createDataFrame([(1, 9), (3, 9)], "id long, label long")
    found = communities.cluster_room_counts(places, clusters)
    assert rows(found) == [(9, "a", 2)]
    assert "LeftSemi" in plan(found)


def test_edges_are_not_sorted_in_a_pass(spark, monkeypatch):
    monkeypatch.setattr(graph.Adjacency, "SMALL", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(200).selectExpr("id % 20 AS src", "id AS dst")
        sent = graph.Adjacency(edges).send(spark.range(20), "id")
        assert sent.count() == 200
        done = sent._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in done and "Sort " not in done
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_zone_is_looked_up_once(spark):
    epochs = [0, -1, 1710054000, 1710053999, 1730613599, 1730613600, 1730617200, -5_000_000_000, None]
    df = spark.createDataFrame([(e,) for e in epochs], "e long")
    plain = F.convert_timezone(F.lit("UTC"), F.lit(cal.LOCAL_ZONE), cal.utc_time(F.col("e")))
    found = df.select(cal.local_time(F.col("e")).alias("wall"), plain.alias("plain"))
    assert found.where("wall IS DISTINCT FROM plain").count() == 0
    assert "convert_timezone" not in plan(found.select("wall"))
