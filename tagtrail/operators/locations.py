"""Object locations over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import calendar as cal
from ..functions.labels import room_name_of_spot
from ..schemas import LOCATION_COLUMNS, NO_META
from ..scale.durable import stored
from ..scale.skew import lookup_join


# Location columns that stay text.
TEXT_COLUMNS = {"spot_name", "spot_description", "site_name", "room_name", "room_floor_name"}


def _leaves(schema: StructType, path: str = "") -> list[str]:
    """Paths of all fields below nested structs."""
    out = []
    for field in schema.fields:
        inner = f"{path}.{field.name}" if path else field.name
        out += _leaves(field.dataType, inner) if isinstance(field.dataType, StructType) \
            else [inner]
    return out


def flatten_locations(objects: DataFrame) -> DataFrame:
    """Nested ``location_visit`` of the catalogue to one flat row per object and visit: nested
    names joined by underscores, numbers as numbers, visit time and date from epoch seconds."""
    columns = [F.col("id").cast("long").alias("refers_to_object_id")]
    for path in _leaves(objects.schema["location_visit"].dataType):
        name = path.replace(".", "_")
        column = F.col(f"location_visit.{path}")
        if name not in TEXT_COLUMNS:
            column = column.cast("long")
        columns.append(column.alias("location_id" if name == "id" else name))
    return objects.filter(F.col("location_visit").isNotNull()).select(*columns) \
        .withColumn("visit_raw", F.col("visit_time")) \
        .withColumns({"visit_time": cal.utc_time(F.col("visit_raw")),
                      "visit_date": cal.utc_date(F.col("visit_raw"))})


def dedupe_locations(locations: DataFrame) -> DataFrame:
    """One row per (object, visit date, room, spot): the earliest visit, then the lowest
    location id."""
    room = "spot_room_id" if "spot_room_id" in locations.columns else "room_id"
    keys = ["refers_to_object_id", "visit_date", room, "spot_id"]
    rest = [c for c in locations.columns if c not in keys]
    first = ["visit_raw", "location_id"]
    row = F.struct(*first, *[c for c in rest if c not in first])
    return locations.groupBy(*keys).agg(F.min(row).alias("row")) \
        .select(*[F.col(c) if c in keys else F.col(f"row.{c}") for c in locations.columns])


def locations_flat(objects: DataFrame) -> DataFrame:
    return dedupe_locations(flatten_locations(objects))


def repeated_objects(locations: DataFrame) -> DataFrame:
    """Objects with more than one location row."""
    return locations.groupBy("refers_to_object_id").agg(F.count(F.lit(1)).alias("n")) \
        .filter("n > 1")


def rooms_table(rooms: DataFrame, spots: DataFrame) -> DataFrame:
    """Rooms with the description of their first spot (lowest spot id), largest first."""
    described = spots.groupBy(room_name_of_spot(F.col("name")).alias("name")) \
        .agg(F.min_by("description", "id").alias("description"))
    return (rooms.join(described, "name", "left")
            .select(F.col("id").cast("int").alias("id"), "name", "floor",
                    F.col("count_objects").alias("room_count_objects"), "count_spots",
                    "description")
            .orderBy(F.desc("room_count_objects"), F.desc("count_spots"), "id"))


def object_loctypes(objects: DataFrame, locations: DataFrame) -> DataFrame:
    """Distinct (object, type) with all location rows of the object."""
    return (objects.select("id", "type").dropDuplicates()
            .join(locations.select(
                F.col("refers_to_object_id").alias("id"), "room_id", "room_name", "room_floor",
                "spot_id", "spot_name", F.col("spot_description").alias("description"),
                "visit_date"), "id"))


def tag_location_deltas(tags: DataFrame, locations: DataFrame) -> DataFrame:
    """Per object and tag day the number of tags, the last visit up to that day and the first after
    it, and how many days away they are. Both sides are one row per object and day before the
    window; objects without a visit have no row."""
    asked = tags.filter(F.col("refers_to_object_id").isNotNull()).groupBy(
        "refers_to_object_id", cal.utc_date(F.col("created")).alias("created_date")) \
        .agg(F.count(F.lit(1)).alias("n_tags")).withColumn("visit", F.lit(None).cast("date"))
    visits = locations.select("refers_to_object_id",
                              cal.utc_date(F.col("visit_raw")).alias("created_date")).distinct() \
        .withColumns({"n_tags": F.lit(None).cast("long"), "visit": F.col("created_date")})
    days = Window.partitionBy("refers_to_object_id").orderBy(F.unix_date("created_date"))
    # A visit on the day itself is the last one.
    last = F.max("visit").over(days.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    later = F.min("visit").over(days.rangeBetween(1, Window.unboundedFollowing))
    both = asked.unionByName(visits).withColumns({"last_visit": last, "next_visit": later})
    return (both.filter("n_tags IS NOT NULL AND (last_visit IS NOT NULL OR next_visit IS NOT NULL)")
            .select("refers_to_object_id", "created_date", "n_tags", "last_visit", "next_visit",
                    F.datediff("created_date", "last_visit").alias("days_since"),
                    F.datediff("next_visit", "created_date").alias("days_until")))


def nearest_by_day(tags: DataFrame, locations: DataFrame) -> DataFrame:
    """For each (object, UTC day) with tags: the location row nearest in days.

    Ties go to the earlier visit, then the lower spot id. Both sides are reduced to one row per
    object and day before the window, so a window group has at most two rows per calendar day
    however popular the object; the nearest row is the last before or the first after, so no
    (tag, location) pairs are made."""
    payload = [c for c in LOCATION_COLUMNS if c in locations.columns]
    row = F.struct("visit_raw", *sorted(payload, key=lambda c: c != "spot_id"),
                   *[c for c in ["location_id"] if c in locations.columns])
    days = stored(tags.filter(F.col("refers_to_object_id").isNotNull()).select(
        "refers_to_object_id", cal.utc_date(F.col("created")).alias("day")).distinct())
    # Visits of objects that no tag asks for go before they are gathered.
    known = locations.join(days.select("refers_to_object_id").distinct(), "refers_to_object_id",
                           "left_semi")
    visits = known.groupBy("refers_to_object_id", cal.utc_date(F.col("visit_raw")).alias("day")) \
        .agg(F.min(row).alias("loc")).withColumn("asked", F.lit(0))
    asked = days.withColumns({"loc": F.lit(None).cast(visits.schema["loc"].dataType),
                              "asked": F.lit(1)})

    key = Window.partitionBy("refers_to_object_id")
    span = (Window.unboundedPreceding, Window.currentRow)
    here = F.when(F.col("loc").isNotNull(), F.struct("day", "loc"))
    # On one day the visit sorts before the question, in both directions.
    around = asked.unionByName(visits).withColumns({
        "before": F.last(here, ignorenulls=True).over(
            key.orderBy("day", "asked").rowsBetween(*span)),
        "after": F.last(here, ignorenulls=True).over(
            key.orderBy(F.desc("day"), "asked").rowsBetween(*span)),
    }).filter("asked = 1")
    to_before = F.datediff("day", "before.day")
    to_after = F.datediff("after.day", "day")
    chosen = F.when(F.col("after").isNull() | (to_before <= to_after), F.col("before")) \
        .otherwise(F.col("after"))
    return (around.withColumn("near", chosen).filter(F.col("near").isNotNull())
            .select("refers_to_object_id", F.col("day").alias("created_day"),
                    F.col("near.loc.visit_raw").alias("visit_raw"),
                    cal.day_gap(F.col("near.day"), F.col("day")).alias("delta"),
                    *[F.col(f"near.loc.{c}").alias(c) for c in payload],
                    F.lit(1).alias("meta_store")))


def nearest_location(tags: DataFrame, locations: DataFrame, keep: tuple[str, ...] = (),
                     base: DataFrame | None = None) -> DataFrame:
    """Tags with the nearest-in-time location of their object; ``meta_store`` tells whether
    there was one. ``keep`` may name ``visit_raw`` and ``delta``. ``base`` is the raw log when
    ``tags`` already carries joined columns; days are looked up on it."""
    base = tags if base is None else base
    day = cal.utc_date(F.col("created"))
    nearest = nearest_by_day(base, locations) \
        .drop(*[c for c in ("visit_raw", "delta") if c not in keep])
    joined = lookup_join(tags.withColumn("created_day", day), nearest,
                         ["refers_to_object_id", "created_day"])
    return joined.drop("created_day").fillna(0, ["meta_store"])


def impute_locations(tags: DataFrame) -> DataFrame:
    """Tags without a location get the marker in the numeric location columns."""
    missing = (F.col("meta_store") == 0) & F.col("room_floor").isNull()
    numeric = ["room_floor", "room_id", "room_count_objects", "room_count_spots", "spot_id",
               "spot_count_objects"]
    return tags.withColumns({
        c: F.when(missing, F.lit(NO_META)).otherwise(F.col(c)).cast("long") for c in numeric})
