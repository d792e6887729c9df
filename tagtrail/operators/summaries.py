"""Descriptive summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import labels
from .journeys import journey_starts


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Non-null values with their counts, most frequent first."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column))


def top_counts(df: DataFrame, column: str, k: int, name: str = "n") -> DataFrame:
    return value_counts(df, column, name).limit(k)


def top_per_group(counts: DataFrame, group: str | Sequence[str], value: str, n: str,
                  k: int) -> DataFrame:
    """The ``k`` largest rows of each group, ties by value. Spark keeps the best ``k`` of each
    group before the shuffle."""
    group = [group] if isinstance(group, str) else list(group)
    order = Window.partitionBy(*group).orderBy(F.desc(n), value)
    return counts.withColumn("_rank", F.row_number().over(order)) \
        .filter(F.col("_rank") <= k).drop("_rank")


def as_map(counts: DataFrame, group: str, value: str, n: str, name: str) -> DataFrame:
    """Value -> count map per group, for groups already cut to a few values."""
    return counts.groupBy(group).agg(
        F.map_from_entries(F.collect_list(F.struct(value, n))).alias(name))


def share(part: Column, total: Column) -> Column:
    return F.when(total != 0, part / total)


# --- D14 -----------------------------------------------------------------------------------

def tag_metrics(tags: DataFrame, objects: DataFrame) -> DataFrame:
    """Twelve figures as (metric, value) rows. ``n_afterhrs_tags`` counts the tags without
    catalogue metadata.

    Two group-bys, by object and by (bundle, hour); everything else is computed on their
    results."""
    one = F.lit(1)
    per_object = tags.groupBy("refers_to_object_id").agg(
        F.count(one).alias("n"),
        F.count(F.when(F.col("tool_id") == 0, one)).alias("wall"),
        F.count(F.when(F.col("tool_id") != 0, one)).alias("drawn"),
        F.count(F.when(F.col("during_exhibition") == 1, one)).alias("during"),
        F.count(F.when(F.col("during_exhibition") == 0, one)).alias("outside"))
    known = objects.select(F.col("id").alias("refers_to_object_id")).dropDuplicates() \
        .withColumn("known", F.lit(True))
    total = F.coalesce(F.sum("n"), F.lit(0))
    with_meta = F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    by_object = per_object.join(known, "refers_to_object_id", "left").agg(
        F.coalesce(F.sum("wall"), F.lit(0)).alias("n_wall_objects_tagged"),
        F.coalesce(F.sum("drawn"), F.lit(0)).alias("n_visitor_objects_tagged"),
        F.count(one).alias("n_unique_wallobjects"),
        total.alias("n_tags"),
        F.count(F.when(F.col("known").isNull(), one)).alias("n_objects_meta_delta"),
        with_meta.alias("nobs_meta_delta"),
        (total - with_meta).alias("n_afterhrs_tags"),
        F.coalesce(F.sum("during"), F.lit(0)).alias("n_during_exhibition_tags"),
        F.coalesce(F.sum("outside"), F.lit(0)).alias("n_nonexhibition_tags"))

    # Zone offsets are whole hours, so the UTC hour fixes the local date; the two equal local
    # hours of an autumn clock change stay apart.
    per_hour = tags.groupBy("bundle_id", cal.hour_start(F.col("created")).alias("hour")) \
        .agg(F.count(one).alias("n"))
    per_day = per_hour.groupBy("bundle_id", cal.local_date(F.col("hour")).alias("day")) \
        .agg(F.sum("n").alias("n"), F.count(one).alias("hours"))
    per_bundle = per_day.groupBy("bundle_id").agg(
        F.sum("n").alias("n"), F.sum("hours").alias("hours"), F.count(one).alias("days"))
    named = F.col("bundle_id").isNotNull()

    def average(units: str) -> Column:
        n = F.sum(F.when(named, F.col("n")))
        return F.floor(n / F.sum(F.when(named, F.col(units))))

    by_bundle = per_bundle.agg(F.count(one).alias("n_unique_bundles"),
                               average("days").alias("n_avgdaily_tags"),
                               average("hours").alias("n_avgdailyhr_tags"))
    return _as_rows(by_object).unionByName(_as_rows(by_bundle))


def _as_rows(one_row: DataFrame) -> DataFrame:
    cast = one_row.select(*[F.col(c).cast("long").alias(c) for c in one_row.columns])
    return cast.unpivot([], cast.columns, "metric", "value")


# Metrics shown on the overview, with their display names.
DISPLAYED = {
    "n_tags": "# tags",
    "n_wall_objects_tagged": "# wall artworks tagged",
    "n_visitor_objects_tagged": "# visitor artworks created tags",
    "n_during_exhibition_tags": "# exhibition tags",
    "n_afterhrs_tags": "# after hours tags",
    "n_tags_via_bursty": "# tags via bursty visitors",
}


def burst_metrics(bursty: DataFrame, bursts: DataFrame) -> DataFrame:
    """Tags by bursty visitors, the sum of anomalies, and the number of bursty journeys."""
    tags = bursty.agg(F.coalesce(F.sum("bursty"), F.lit(0)).alias("n_tags_via_bursty"))
    journeys = bursts.agg(
        F.coalesce(F.sum("n_anomalies"), F.lit(0)).alias("n_anomalies_total"),
        F.count(F.when(F.col("n_anomalies") > 0, 1)).alias("n_bursty_journeys"))
    return _as_rows(tags).unionByName(_as_rows(journeys))


def displayed_metrics(metrics: DataFrame) -> DataFrame:
    """The overview subset of (metric, value) rows under display names, largest first."""
    name = F.lit(None).cast("string")
    for metric, shown in DISPLAYED.items():
        name = F.when(F.col("metric") == metric, F.lit(shown)).otherwise(name)
    return (metrics.filter(F.col("metric").isin(*DISPLAYED))
            .select(name.alias("metric"), "value").orderBy(F.desc("value"), "metric"))


# --- D15 -----------------------------------------------------------------------------------

def scans_per(tags: DataFrame, part: str) -> DataFrame:
    """Tags per calendar part, in calendar order."""
    return tags.filter(F.col(part).isNotNull()).groupBy(part) \
        .agg(F.count(F.lit(1)).alias("n_tags")).orderBy(part)


def scans_per_hour(tags: DataFrame, first: int = 5, last: int = 23) -> DataFrame:
    counts = scans_per(tags.filter(F.col("hour").between(first, last)), "hour")
    return counts.withColumn("label", labels.hour_label(F.col("hour")))


def scans_per_exhibition(tags: DataFrame) -> DataFrame:
    return scans_per(tags, "during_exhibition") \
        .withColumn("label", labels.exhibition_name(F.col("during_exhibition")))


def scans_per_closing(tags: DataFrame) -> DataFrame:
    return scans_per(tags, "tagged_after_close") \
        .withColumn("label", labels.closing_name(F.col("tagged_after_close")))


def log_counts(counts: DataFrame, column: str = "n_tags") -> DataFrame:
    """Natural logarithm of the counts, for log-scaled display."""
    return counts.withColumn(f"log_{column}", F.ln(F.col(column)))


# --- D16 -----------------------------------------------------------------------------------

def popular_floors(located: DataFrame) -> DataFrame:
    return value_counts(located, "room_floor", "n_tags")


def popular_rooms(locations: DataFrame, k: int = 7) -> DataFrame:
    """Rooms by number of location rows."""
    return top_counts(locations, "room_name", k, "location_rows")


def popular_spots(locations: DataFrame, k: int = 7) -> DataFrame:
    return top_counts(locations, "spot_name", k, "location_rows") \
        .withColumn("spot_label", labels.spot_label(F.col("spot_name")))


def first_tag_items(tags: DataFrame) -> DataFrame:
    """How many journeys start at each object."""
    return value_counts(journey_starts(tags), "object_id", "n_journeys")


def first_tag_rooms(tags: DataFrame, objects: DataFrame, locations: DataFrame,
                    k: int = 7) -> DataFrame:
    """Journey starts by room; a start counts once per location row of its object.

    Location rows are counted per object and room first, so the join has one row per (object,
    room)."""
    starts = journey_starts(tags).groupBy("object_id").agg(F.count(F.lit(1)).alias("starts"))
    known = objects.groupBy(F.col("id").alias("object_id")) \
        .agg(F.count(F.lit(1)).alias("entries"))
    places = locations.groupBy(F.col("refers_to_object_id").alias("object_id"), "room_name") \
        .agg(F.count(F.lit(1)).alias("rows"))
    return (starts.join(known, "object_id").join(places, "object_id")
            .groupBy("room_name")
            .agg(F.sum(F.col("starts") * F.col("entries") * F.col("rows")).alias("n_first_tags"))
            .orderBy(F.desc("n_first_tags"), "room_name").limit(k))


def high_capacity_rooms(rooms: DataFrame, k: int = 7) -> DataFrame:
    return rooms.orderBy(F.desc("count_objects"), F.desc("count_spots"), "id") \
        .limit(k).select("id", "name", "count_objects", "count_spots")


# --- D17-D19 ---------------------------------------------------------------------------------

# Object types asked for by default.
QUERY_TYPES = ["Concept art", "Drawing", "poster", "Print", "Sidewall", "textile",
               "Staircase model"]


def room_type_counts(loctypes: DataFrame, types: Sequence[str] = QUERY_TYPES,
                     k: int = 5) -> DataFrame:
    counts = (loctypes.filter(F.col("type").isin(*types) & F.col("room_name").isNotNull())
              .groupBy("type", "room_name").agg(F.count(F.lit(1)).alias("n")))
    return top_per_group(counts, "type", "room_name", "n", k) \
        .withColumnsRenamed({"type": "query"})


def room_types(loctypes: DataFrame, types: Sequence[str] = QUERY_TYPES, k: int = 5) -> DataFrame:
    """For each asked type a map of its ``k`` most frequent rooms; types without rooms get an
    empty map."""
    found = as_map(room_type_counts(loctypes, types, k), "query", "room_name", "n", "rooms")
    asked = loctypes.sparkSession.createDataFrame([(t,) for t in types], "query string")
    empty = F.create_map().cast(found.schema["rooms"].dataType)
    return asked.join(found, "query", "left").withColumn("rooms", F.coalesce("rooms", empty))


def types_in_room(loctypes: DataFrame, room_name: str) -> DataFrame:
    return value_counts(loctypes.filter(F.col("room_name") == room_name), "type")


def rooms_named(rooms: DataFrame, names: Sequence[str]) -> DataFrame:
    return rooms.filter(F.col("name").isin(*names))


def objects_meta(objects: DataFrame) -> DataFrame:
    return objects.select(F.col("id").alias("refers_to_object_id"), "department_id",
                          "is_loan_object")

