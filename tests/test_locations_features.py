"""Locations, nearest-in-time lookup, feature matrix, summaries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtrail.functions import frames
from tagtrail.scale import durable
from tagtrail.operators import features, locations, statistics, summaries

DAY = 86400
SCHEMA = ("refers_to_object_id long, location_id long, visit_raw long, room_floor int, "
          "room_id int, room_name string, spot_id long, spot_name string, "
          "spot_description string, room_count_objects long, room_count_spots long, "
          "spot_count_objects long")


def place(obj, loc, visit, spot, room=1):
    return (obj, loc, visit, 2, room, str(200 + room), spot, f"F, {200 + room}, Spot {spot}", "d",
            10, 3, 4)


def tags(spark, rows):
    return spark.createDataFrame(rows, "id long, refers_to_object_id long, created long")


@pytest.mark.usefixtures("joins")
def test_nearest_ties_and_missing(spark):
    where = spark.createDataFrame([
        place(1, 1, 10 * DAY + 5, 7), place(1, 2, 14 * DAY, 3), place(1, 3, 14 * DAY, 2),
        place(2, 4, 50 * DAY, 9)], SCHEMA)
    log = tags(spark, [(1, 1, 12 * DAY + 9), (2, 1, 12 * DAY + 10), (3, 1, 13 * DAY),
                       (4, 1, 40 * DAY), (5, 3, 12 * DAY), (6, None, 12 * DAY), (7, 2, DAY),
                       (8, 1, 10 * DAY + 80000), (9, 1, 12 * DAY + 9)])
    df = locations.nearest_location(log, where, keep=("visit_raw", "delta"))
    got = {r["id"]: (r["spot_id"], r["delta"], r["meta_store"]) for r in df.collect()}
    assert got == {1: (7, 2, 1), 2: (7, 2, 1), 3: (2, 1, 1), 4: (2, 26, 1), 5: (None, None, 0),
                   6: (None, None, 0), 7: (9, 49, 1), 8: (7, 0, 1), 9: (7, 2, 1)}


def test_nearest_against_brute_force(spark):
    rng = random.Random(3)
    where = [place(rng.randint(1, 6), i, rng.randint(0, 40) * DAY + rng.randint(0, DAY - 1),
                   rng.randint(1, 9)) for i in range(60)]
    log = [(i, rng.randint(1, 7), rng.randint(0, 45 * DAY)) for i in range(200)]
    df = locations.nearest_location(tags(spark, log), spark.createDataFrame(where, SCHEMA),
                                    keep=("visit_raw", "delta"))
    got = {r["id"]: (r["delta"], r["visit_raw"], r["spot_id"]) for r in df.collect()}
    for i, obj, created in log:
        options = [(abs(created // DAY - w[2] // DAY), w[2], w[6]) for w in where if w[0] == obj]
        assert got[i] == (min(options) if options else (None, None, None))


def test_flatten_and_dedupe(spark, rows):
    schema = ("id long, location_visit struct<id:string, visit_time:string, room:struct<id:string,"
              "name:string>, spot:struct<id:string, room_id:string, name:string>>")
    nested = spark.createDataFrame([
        (1, ("11", "100", ("4", "204"), ("9", "4", "x"))),
        (1, ("10", "100", ("4", "204"), ("9", "4", "x"))),
        (1, ("12", "200", ("4", "204"), ("9", "4", "x"))),
        (1, ("13", str(DAY), ("4", "204"), ("9", "4", "x"))),
        (2, ("14", "100", ("4", "204"), ("9", "4", "x"))), (3, None)], schema)
    flat = locations.flatten_locations(nested)
    assert dict(flat.dtypes)["room_id"] == "bigint" and dict(flat.dtypes)["room_name"] == "string"
    assert flat.count() == 5
    assert rows(locations.locations_flat(nested), "refers_to_object_id", "location_id") == \
        [(1, 10), (1, 13), (2, 14)]
    assert rows(locations.repeated_objects(flat)) == [(1, 4)]


def test_rooms_take_the_first_spot(spark, rows):
    rooms = spark.createDataFrame([("1", "201", 2, 5, 2), ("2", "202", 2, 9, 1),
                                   ("3", "Hall", 1, 9, 4)],
                                  "id string, name string, floor int, count_objects long, "
                                  "count_spots long")
    spots = spark.createDataFrame([(8, "F, 201, b", "later"), (3, "F, 201, a", "first"),
                                   (5, "Hall", "hall")], "id long, name string, description string")
    got = locations.rooms_table(rooms, spots).select("id", "description").collect()
    assert [tuple(r) for r in got] == [(3, "hall"), (2, None), (1, "first")]


def modelled(spark, n=40):
    rng = random.Random(5)
    out = []
    for i in range(n):
        known = i % 5 != 0
        out.append((i, rng.randint(1, 31), rng.randint(0, 6), rng.randint(0, 23),
                    rng.randint(1, 12), rng.randint(1, 4), 0, 2016, 0, 1, 0, int(known), i % 2,
                    2 if known else None, rng.randint(1, 3) if known else None,
                    [5, 7, 9, 30, 31, 90][i % 6] if known else None, 3 if known else None,
                    i if known else None, rng.randint(1, 50) if known else None))
    return spark.createDataFrame(out, "id int, day int, dow int, hour int, month int, quarter int,"
                                 "weekend int, year int, tagged_after_close int,"
                                 "during_exhibition int, visitor_drawn int, meta_store int,"
                                 "bursty int, room_floor int, room_id int, room_count_objects long,"
                                 "room_count_spots long, spot_id long, spot_count_objects long")


def test_bin_edges_are_percentiles_of_distinct_values(spark):
    df = features.prepare(modelled(spark))
    levels = features.find_levels(df)
    local = df.toPandas()
    for column, percents, edges in (
            ("room_count_objects", [70, 85, 90, 95], levels.room_edges),
            ("spot_count_objects", [50, 90, 95, 100], levels.spot_edges)):
        distinct = sorted(local[column].unique())[1:]
        assert edges == pytest.approx([np.percentile(distinct, p) for p in percents])
    bins = features.room_capacity_bins(df, levels)
    top = bins.filter("room_count_objects = 90").select("room_capacity").distinct().collect()
    assert [r[0] for r in top] == [None]
    assert bins.filter("meta_store = 0").select("room_capacity").distinct().first()[0] == \
        "room_nometa"


def test_feature_matrix(spark):
    df = features.feature_matrix(modelled(spark))
    row = {r["id"]: r.asDict() for r in df.collect()}
    source = {r["id"]: r for r in modelled(spark).collect()}
    assert len(row) == 40
    for i, r in row.items():
        s = source[i]
        assert sum(r[c] for c in ["pre-morning", "morning", "afternoon", "evening", "night"]) == \
            int(s["hour"] > 0)
        assert sum(r[c] for c in ["Mon", "Tues", "Wed", "Thur", "Fri"]) == int(s["dow"] < 5)
        assert r[f"month_{s['month']}"] == 1 and r[f"quarter_{s['quarter']}"] == 1
        assert r["room_-9999"] == int(s["meta_store"] == 0)
        assert r["is_bursty"] == s["bursty"]
        assert None not in r.values()
    groups = frames.feature_groups(df.columns)
    assert groups["turnover"] == ["spot_constant_freq", "spot_normal_freq", "spot_high_freq",
                                  "spot_dynamic_freq"]
    assert groups["floor"] == ["floor_-9999", "floor_2"]


def test_room_columns_are_renamed():
    got = frames.room_renames(["room_4", "room_-9999", "room_9999", "room_small_cap",
                               "room_nometa", "floor_1"], {4: "103", 9999: "x"})
    assert got == {"room_4": "rm_103"}


def test_room_types(spark, rows):
    table = spark.createDataFrame([("Print", "201"), ("Print", "201"), ("Print", "202"),
                                   ("Print", "203"), ("poster", "201")],
                                  "type string, room_name string")
    got = {r["query"]: r["rooms"] for r in summaries.room_types(
        table, ["Print", "poster", "Drawing"], k=2).collect()}
    assert got == {"Print": {"201": 2, "202": 1}, "poster": {"201": 1}, "Drawing": {}}
    assert rows(summaries.types_in_room(table, "201")) == [("Print", 2), ("poster", 1)]


def test_metrics_count_nulls_as_a_value(spark):
    log = spark.createDataFrame([
        (1, 0, "a", 5, 0, 0), (2, 0, "a", 0, 10, 1), (3, 1, None, None, 20, 0),
        (4, 0, "b", 9, 7200, 0)],
        "id long, tool_id int, bundle_id string, refers_to_object_id long, created long, "
        "during_exhibition int")
    objects = spark.createDataFrame([(5,), (5,), (7,)], "id long")
    got = dict(summaries.tag_metrics(log, objects).collect())
    assert got == {"n_wall_objects_tagged": 3, "n_visitor_objects_tagged": 1,
                   "n_unique_wallobjects": 4, "n_unique_bundles": 3, "n_tags": 4,
                   "n_objects_meta_delta": 3, "nobs_meta_delta": 1, "n_afterhrs_tags": 3,
                   "n_during_exhibition_tags": 1, "n_nonexhibition_tags": 3,
                   "n_avgdaily_tags": 1, "n_avgdailyhr_tags": 1}


def test_drop_time_columns(spark):
    df = spark.range(1).withColumns({"d": F.current_date(), "t": F.current_timestamp(),
                                     "n": F.lit("2016-01-01").cast("timestamp_ntz"),
                                     "s": F.lit("x")})
    assert frames.drop_time_columns(df).columns == ["id", "s"]
    assert frames.sanitize_names(spark.range(1).toDF("a.b")).columns == ["a_b"]


def test_level_sets_are_the_ones_of_the_matrix(spark):
    matrix = {r["id"]: {c for c, x in r.asDict().items() if c != "id" and x == 1}
              for r in features.feature_matrix(modelled(spark)).collect()}
    sets = features.level_sets(modelled(spark)).cache()
    assert {r["id"]: set(r["levels"]) for r in sets.collect()} == matrix
    numbered = features.dictionary(sets).cache()
    places = {r["level"]: r["index"] for r in numbered.collect()}
    assert places == {n: i for i, n in enumerate(sorted(set().union(*matrix.values())))}
    codes = features.coded(sets, numbered).cache()
    assert {r["id"]: r["indices"] for r in codes.collect()} == \
        {i: sorted(places[n] for n in names) for i, names in matrix.items()}
    back = {}
    for r in features.decoded(codes, numbered).collect():
        back.setdefault(r["id"], set()).add(r["level"])
    assert back == {i: n for i, n in matrix.items() if n}


def test_level_correlation_is_that_of_the_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 6)) < [0.1, 0.5, 0.9, 0.3, 1.0, 0.5]
    sets = spark.createDataFrame([([f"f{k}" for k in range(6) if row[k]],) for row in x],
                                 "levels array<string>")
    got = {r["level"]: r["corr"] for r in statistics.level_correlation(sets, "f1").collect()}
    assert got.pop("f4") is None
    for level, corr in got.items():
        assert corr == pytest.approx(np.corrcoef(x[:, int(level[1])], x[:, 1])[0, 1])
    assert statistics.level_correlation(sets.limit(0), "f1").count() == 0


def test_many_thousand_levels_are_no_columns(spark):
    sets = spark.range(60_000).selectExpr(
        "id", "array(concat('room_', id), concat('m_', id % 3)) AS levels")
    numbered = features.dictionary(sets).cache()
    assert numbered.count() == 60_003
    assert numbered.agg({"index": "max"}).first()[0] == 60_002
    assert statistics.level_correlation(sets, "m_1").count() == 60_003


def test_levels_are_looked_up_once_for_each_distinct_set(spark, monkeypatch):
    rows = [(i, ["a", "b"] if i % 2 else ["b", "c", "d"]) for i in range(200)]
    rows += [(1, ["d"]), (1000, []), (None, ["a"])]
    sets = spark.createDataFrame(rows, "id long, levels array<string>").repartition(4)
    numbered = features.dictionary(sets)
    made = {}

    def kept(df, name="table"):
        out = durable.stored(df, name)
        made[name] = out.count()
        return out
    monkeypatch.setattr(features, "stored", kept)
    got = sorted((str(r["id"]), r["indices"]) for r in features.coded(sets, numbered).collect())
    assert made["kinds"] == 5
    # Rows of a key share what they have; a null key meets none.
    want = [(i, [0, 1] if i % 2 else [1, 2, 3]) for i in range(200) if i != 1]
    want += [(1, [0, 1, 3])] * 2 + [(1000, []), (None, [])]
    assert got == sorted((str(i), x) for i, x in want)
