"""Feature matrix of located, bursty tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binning as b
from ..functions import calendar as cal
from ..scale.durable import stored
from ..scale.skew import lookup_join
from .locations import impute_locations
from .selection import distinct_percentiles

# Columns that are flags already.
FLAGS = ["weekend", "tagged_after_close", "during_exhibition", "visitor_drawn", "meta_store"]

# Weekday columns; Saturday and Sunday are covered by ``weekend``.
WEEKDAYS = {0: "Mon", 1: "Tues", 2: "Wed", 3: "Thur", 4: "Fri"}

# Columns whose levels become indicator columns, with their prefix.
FAMILIES = {"wom": "wom", "year": "year", "month": "month", "quarter": "quarter",
            "room_id": "room", "room_floor": "floor"}


@dataclass(frozen=True)
class Levels:
    """What the matrix needs to know about all rows: category levels and bin edges."""

    values: dict[str, list[int]]
    room_edges: list[float]
    spot_edges: list[float]


def prepare(tags: DataFrame) -> DataFrame:
    """Imputed locations and the week of the month."""
    return impute_locations(tags).withColumn("wom", cal.week_of_month(F.col("day")))


def find_levels(prepared: DataFrame) -> Levels:
    """Levels and bin edges; what reaches the driver is as long as the column list. Bin edges are
    percentiles of the distinct counts without the smallest, however many those are."""
    row = prepared.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in FAMILIES]).first()
    return Levels({c: list(row[c]) for c in FAMILIES},
                  distinct_percentiles(prepared, "room_count_objects", b.ROOM_PERCENTS, skip=1),
                  distinct_percentiles(prepared, "spot_count_objects", b.SPOT_PERCENTS, skip=1))


def room_capacity(levels: Levels) -> Column:
    return b.right_closed(F.col("room_count_objects"), b.BIN_FLOOR + levels.room_edges,
                          b.ROOM_LABELS)


def spot_turnover(levels: Levels) -> Column:
    return b.right_closed(F.col("spot_count_objects"), b.BIN_FLOOR + levels.spot_edges,
                          b.SPOT_LABELS)


def room_capacity_bins(prepared: DataFrame, levels: Levels | None = None) -> DataFrame:
    levels = levels or find_levels(prepared)
    return prepared.withColumn("room_capacity", room_capacity(levels))


def spot_turnover_bins(prepared: DataFrame, levels: Levels | None = None) -> DataFrame:
    levels = levels or find_levels(prepared)
    return prepared.withColumn("spot_turnover", spot_turnover(levels))


def one_hot(column: Column | str, levels: list, prefix: str) -> dict[str, Column]:
    column = F.col(column) if isinstance(column, str) else column
    return {f"{prefix}_{v}": b.indicator(column == F.lit(v)) for v in levels}


def feature_columns(levels: Levels) -> dict[str, Column]:
    hour, dow = b.hour_bin(F.col("hour")), F.col("dow")
    room, spot = room_capacity(levels), spot_turnover(levels)
    out = {label: b.indicator(hour == label) for label in b.HOUR_LABELS}
    out.update({name: b.indicator(dow == d) for d, name in WEEKDAYS.items()})
    for column, prefix in FAMILIES.items():
        out.update(one_hot(column, levels.values[column], prefix))
    out.update({label: b.indicator(room == label) for label in b.ROOM_LABELS})
    out.update({label: b.indicator(spot == label) for label in b.SPOT_LABELS})
    out["is_bursty"] = b.indicator(F.col("bursty") == 1)
    out.update({flag: F.col(flag).cast("int") for flag in FLAGS})
    return out


def feature_matrix(tags: DataFrame, keys: tuple[str, ...] = ("id",),
                   levels: Levels | None = None) -> DataFrame:
    """Indicator columns of every tag, in one projection. ``tags`` carries the calendar, flag,
    burst and location columns."""
    prepared = prepare(tags)
    levels = levels or find_levels(prepared)
    columns = feature_columns(levels)
    return prepared.select(*keys, *[c.alias(name) for name, c in columns.items()])


# --- the same as sets of levels ----------------------------------------------------------------------

def level_sets(tags: DataFrame, keys: tuple[str, ...] = ("id",),
               edges: Levels | None = None) -> DataFrame:
    """(keys, levels): of every tag the names of the matrix columns that are 1, in order. Nothing is
    collected but bin edges, and a vocabulary of any size is no wider than one of ten."""
    prepared = prepare(tags)
    edges = edges or Levels({}, *[distinct_percentiles(prepared, c, p, skip=1) for c, p in (
        ("room_count_objects", b.ROOM_PERCENTS), ("spot_count_objects", b.SPOT_PERCENTS))])
    day = F.lit(None).cast("string")
    for number, name in WEEKDAYS.items():
        day = F.when(F.col("dow") == number, F.lit(name)).otherwise(day)
    names = [b.hour_bin(F.col("hour")), day, room_capacity(edges), spot_turnover(edges),
             F.when(F.col("bursty") == 1, F.lit("is_bursty"))]
    names += [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{prefix}_"), F.col(c).cast("string")))
              for c, prefix in FAMILIES.items()]
    names += [F.when(F.col(flag).cast("int") == 1, F.lit(flag)) for flag in FLAGS]
    return prepared.select(*keys, F.array_sort(F.array_compact(F.array(*names))).alias("levels"))


def dictionary(sets: DataFrame) -> DataFrame:
    """(level, index): the levels in use, numbered from 0 in their order."""
    placed = stored(sets.select(F.explode("levels").alias("level")).distinct()
                    .repartitionByRange("level").withColumn("part", F.spark_partition_id()), "levels")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("level")) - 1
    return placed.withColumn("nth", nth).join(shifts, "part") \
        .select("level", (F.col("shift") + F.col("nth")).alias("index"))


def coded(sets: DataFrame, numbered: DataFrame, key: str = "id") -> DataFrame:
    """(key, indices): sparse indicator vectors, as the ascending indices that are 1. Levels are looked
    up once for every distinct set, and rows meet their set whole, so that a row stays one row in what
    is shuffled. Rows of one key share what they have; a frequent set is one row of a look-up, whose
    join can be split."""
    kinds = stored(sets.select("levels").distinct()
                   .withColumn("kind", F.monotonically_increasing_id()), "kinds")
    found = kinds.select("kind", F.explode("levels").alias("level")).join(numbered, "level") \
        .groupBy("kind").agg(F.collect_list("index").alias("some"))
    known = kinds.join(found, "kind").select("levels", "some")
    some = lookup_join(sets.select(key, "levels"), known, ["levels"], "inner") \
        .groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("indices"))
    return sets.select(key).join(some, key, "left") \
        .withColumn("indices", F.coalesce("indices", F.array().cast("array<long>")))


def decoded(codes: DataFrame, numbered: DataFrame, key: str = "id") -> DataFrame:
    """(key, level): a row for each indicator that is 1."""
    return codes.select(key, F.explode("indices").alias("index")).join(numbered, "index") \
        .select(key, "level")
