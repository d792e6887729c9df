"""Calendar, closing time, exhibitions, journeys and bursts on hand-made rows."""

import calendar as pycal
from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagtrail.functions import binning, calendar as cal, labels
from tagtrail.operators import exhibitions, journeys, summaries, times
from tagtrail.schemas import TAGS

EAST = ZoneInfo("US/Eastern")


def at(text, zone=EAST):
    return int(datetime.fromisoformat(text).replace(tzinfo=zone).timestamp())


def tags(spark, rows):
    """Rows of (id, tool, bundle, object, created)."""
    return spark.createDataFrame(rows, TAGS)


@pytest.mark.parametrize("text, flag", [
    ("2016-03-11 18:00:00", 0), ("2016-03-11 18:00:01", 1), ("2016-03-12 20:59:00", 0),
    ("2016-03-12 21:00:00", 0), ("2016-03-12 21:00:01", 1), ("2016-03-13 19:00:00", 1)])
def test_closing_time(spark, text, flag):
    df = times.closing_time_flag(times.tag_time_features(tags(spark, [(1, 0, "a", 5, at(text))])))
    assert df.first()["tagged_after_close"] == flag


def test_calendar_parts_match_the_standard_library(spark):
    epochs = [at("2016-01-01 00:30:00"), at("2016-02-29 23:59:59"), at("2015-11-01 01:30:00"),
              at("2016-12-31 12:00:00"), at("2016-03-13 03:00:00")]
    df = times.tag_time_features(tags(spark, [(i, i % 2, "a", 5, e)
                                              for i, e in enumerate(epochs)]))
    for row in df.collect():
        wall = datetime.fromtimestamp(row["created"], EAST)
        assert row["created_date_est"] == wall.date()
        assert row["created_dateformat_est"] == wall.replace(tzinfo=None)
        assert row["created_dateformat"] == datetime.fromtimestamp(
            row["created"], timezone.utc).replace(tzinfo=None)
        assert (row["year"], row["month"], row["day"], row["hour"]) == \
            (wall.year, wall.month, wall.day, wall.hour)
        assert row["dow"] == pycal.weekday(wall.year, wall.month, wall.day)
        assert row["week"] == wall.isocalendar().week
        assert row["weekend"] == int(row["dow"] > 4)
        assert row["quarter"] == (wall.month + 2) // 3
        assert row["visitor_drawn"] == row["id"] % 2


def test_results_do_not_depend_on_the_session_zone(spark):
    frame = tags(spark, [(1, 0, "a", 5, at("2016-03-11 23:30:00"))])
    before = times.tag_time_features(frame).first()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert times.tag_time_features(frame).first() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hours_of_a_clock_change_stay_apart(spark):
    first, second = at("2015-11-01 05:30:00", timezone.utc), at("2015-11-01 06:30:00",
                                                                timezone.utc)
    frame = tags(spark, [(1, 0, "a", 5, first), (2, 0, "a", 6, second)]) \
        .withColumn("during_exhibition", F.lit(0))
    objects = spark.createDataFrame([(5,)], "id long")
    found = dict(summaries.tag_metrics(frame, objects).collect())
    assert found["n_avgdailyhr_tags"] == 1 and found["n_avgdaily_tags"] == 2


def test_hour_bins_and_week_of_month(spark):
    hours = spark.createDataFrame([(h,) for h in (0, 10, 11, 12, 13, 17, 18, 20, 21, 23)], "h int")
    got = [r[0] for r in hours.select(binning.hour_bin(F.col("h"))).collect()]
    assert got == [None, "pre-morning", "morning", "morning", "afternoon", "afternoon", "evening",
                   "evening", "night", "night"]
    days = spark.createDataFrame([(d,) for d in (1, 6, 7, 13, 14, 27, 28, 31)], "d int")
    assert [r[0] for r in days.select(cal.week_of_month(F.col("d"))).collect()] == \
        [1, 1, 2, 2, 3, 4, 4, 4]


def test_text_labels(spark):
    names = spark.createDataFrame([("Second Floor, 206, Spot 2",), ("Lobby, Desk",), ("Hall",)],
                                  "n string")
    assert [tuple(r) for r in names.select(labels.room_name_of_spot(F.col("n")),
                                           labels.spot_label(F.col("n"))).collect()] == \
        [("206", "Spot 2"), ("Desk", ""), ("Hall", "")]
    hours = spark.createDataFrame([(9,), (12,), (15,)], "h int")
    assert [r[0] for r in hours.select(labels.hour_label(F.col("h"))).collect()] == \
        ["9am", "12pm", "3pm"]


# --- exhibitions -----------------------------------------------------------------------------

def shows(spark):
    raw = spark.createDataFrame(
        [("25", "2016-03-01", "2016-03-10", 1), ("105", "2016-06-01", "2016-06-10", 2),
         ("3", "2016-01-01", "0000-00-00", 3)],
        "id string, date_start string, date_end string, ordinal int")
    members = spark.createDataFrame([("25", 7), ("105", 7), ("25", 8), ("3", 9)],
                                    "exhibition_id string, object_id long")
    return exhibitions.exhibitions_clean(raw), members


def during(spark, mode):
    clean, members = shows(spark)
    frame = times.with_times(tags(spark, [
        (1, 0, "a", 7, at("2016-03-05 12:00:00")), (2, 0, "a", 7, at("2016-06-05 12:00:00")),
        (3, 0, "a", 8, at("2016-03-01 00:00:00")), (4, 0, "a", 8, at("2016-03-10 00:00:00")),
        (5, 0, "a", 9, at("2016-03-05 12:00:00")), (6, 0, "a", None, at("2016-03-05 12:00:00"))]))
    got = exhibitions.during_exhibition(frame, clean, members, mode)
    return {r["id"]: r["during_exhibition"] for r in got.collect()}


def test_open_ended_exhibitions_are_dropped(spark):
    clean, _ = shows(spark)
    row = {r["id"]: r for r in clean.collect()}
    assert set(row) == {"25", "105"}
    assert row["25"]["created_date_start"] == date(2016, 3, 1)
    assert row["25"]["created_time_span"].days == 9


@pytest.mark.usefixtures("joins")
def test_last_exhibition_decides(spark):
    assert during(spark, "last") == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}


@pytest.mark.usefixtures("joins")
def test_any_exhibition(spark):
    assert during(spark, "any") == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}


def test_objects_of_documents(spark, rows):
    docs = spark.createDataFrame([("1", [(5,), (6,)]), ("2", []), ("1", [(7,)])],
                                 "_id string, objects array<struct<id:long>>")
    assert rows(exhibitions.exhibition_objects(docs)) == [("1", 5), ("1", 6), ("1", 7)]


# --- journeys --------------------------------------------------------------------------------

NOON = at("2016-03-11 12:00:00")


def test_journey_order_and_same_second(spark):
    df = journeys.bundle_journeys(tags(spark, [
        (1, 0, "a", 50, NOON + 60), (2, 0, "a", 51, NOON), (3, 0, "a", 52, NOON),
        (4, 1, "a", 53, NOON + 5), (5, 0, "a", 0, NOON + 6), (6, 0, None, 54, NOON),
        (7, 0, "a", 55, at("2016-03-12 00:00:00"))]))
    got = {r["created_date_est"]: (r["object_ids"], [s["created"] for s in r["steps"]])
           for r in df.collect()}
    assert got == {date(2016, 3, 11): ([52, 50], [NOON, NOON + 60]),
                   date(2016, 3, 12): ([55], [at("2016-03-12 00:00:00")])}


def test_transitions_stay_inside_a_journey(spark, rows):
    df = journeys.transitions(tags(spark, [
        (1, 0, "a", 1, NOON), (2, 0, "a", 2, NOON + 1), (3, 0, "a", 2, NOON + 2),
        (4, 0, "b", 3, NOON + 3), (5, 0, "a", 4, NOON + 86400)]))
    assert rows(df) == [(1, 2), (2, 2)]


def literal_bursts(stamps):
    """The rule as stated, on a zero-filled pandas series."""
    if len(stamps) <= 1:
        return 0
    series = pd.Series(1, index=pd.to_datetime(sorted(stamps), unit="s"))
    counts = series.resample("10min").count()
    mean = counts.rolling(2, center=True).mean()
    spread = np.nanstd(mean) if len(counts) > 1 else np.nan
    return int(sum(c > m + 3 * spread for c, m in zip(counts, mean)))


@pytest.mark.parametrize("buckets, expected", [
    ([1], 0), ([2], 0), ([1, 1], 0), ([1, 0, 1], 1), ([1, 0, 0, 0, 5], None),
    ([1] * 30 + [9], None), ([3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 7, 1], None)])
def test_burst_rule(spark, buckets, expected):
    stamps = [NOON + 600 * i + s for i, n in enumerate(buckets) for s in range(n)]
    df = journeys.burst_anomalies(tags(spark, [(i, 0, "a", 1, t) for i, t in enumerate(stamps)]))
    row = df.first()
    assert row["n_obs"] == len(stamps)
    assert row["n_anomalies"] == (literal_bursts(stamps) if expected is None else expected)


def test_burst_rule_on_random_journeys(spark):
    rng = np.random.default_rng(7)
    stamps = {b: np.unique(NOON + rng.integers(0, 8 * 3600, rng.integers(1, 40)))
              for b in "abcdefghijklmnop"}
    frame = tags(spark, [(int(f"{i}{j:03d}"), 0, b, 1, int(t))
                         for i, (b, ts) in enumerate(stamps.items(), 1)
                         for j, t in enumerate(ts)])
    got = {r["bundle_id"]: r["n_anomalies"] for r in journeys.burst_anomalies(frame).collect()}
    assert got == {b: literal_bursts(list(ts)) for b, ts in stamps.items()}


def test_resampled_counts(spark):
    df = journeys.resampled_counts(tags(spark, [
        (1, 0, "a", 1, NOON), (2, 0, "a", 1, NOON + 10), (3, 0, "a", 1, NOON + 1800)]))
    got = [(r["n"], r["rolling_mean"]) for r in df.orderBy("bucket").collect()]
    assert got == [(2, None), (0, 1.0), (0, 0.0), (1, 0.5)]


@pytest.mark.usefixtures("joins")
def test_tags_without_a_journey_get_the_marker(spark):
    frame = times.with_times(tags(spark, [(1, 0, "a", 1, NOON), (2, 1, "b", 0, NOON),
                                          (3, 1, "a", 0, NOON + 1200),
                                          (4, 0, "a", 2, NOON + 1300)]))
    df = journeys.bursty_tags(frame, journeys.burst_anomalies(frame))
    got = {r["id"]: (r["n_obs"], r["n_anomalies"], r["bursty"]) for r in df.collect()}
    assert got == {1: (2, 1, 1), 2: (-9999, -9999, 0), 3: (2, 1, 1), 4: (2, 1, 1)}
