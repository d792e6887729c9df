"""Exhibition spans (D03), their objects (D04) and the overlap flag on tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..scale.skew import lookup_join


def exhibitions_clean(exhibitions: DataFrame) -> DataFrame:
    """Parse the span; exhibitions without an end date are dropped before parsing."""
    return (exhibitions.filter(F.col("date_end") != "0000-00-00")
            .withColumns({"created_date_start": cal.parse_day(F.col("date_start")),
                          "created_date_end": cal.parse_day(F.col("date_end"))})
            .withColumn("created_time_span",
                        F.col("created_date_end") - F.col("created_date_start")))


def exhibition_objects(docs: DataFrame) -> DataFrame:
    """(exhibition_id, object_id) of the exhibition documents that list objects."""
    return (docs.filter(F.size("objects") > 0)
            .select(F.col("_id").alias("exhibition_id"), F.explode("objects").alias("o"))
            .select("exhibition_id", F.col("o.id").cast("long").alias("object_id")))


def _spans(clean: DataFrame, members: DataFrame, order: str) -> DataFrame:
    spans = clean.select(F.col("id").cast("string").alias("exhibition_id"),
                         F.col(order).alias("ordinal"), "created_date_start", "created_date_end")
    return (members.select(F.col("exhibition_id").cast("string").alias("exhibition_id"),
                           F.col("object_id").alias("refers_to_object_id"))
            .join(spans, "exhibition_id"))


def during_exhibition(tags: DataFrame, clean: DataFrame, members: DataFrame,
                      mode: str = "last", order: str = "ordinal") -> DataFrame:
    """Flag tags whose local date lies in ``[start, end)`` of an exhibition holding the object.

    ``mode="last"``: of several exhibitions the last in ``order`` decides, also when it says 0.
    ``order`` names a column of ``clean`` that holds the place of the exhibition in its list; ids
    are text and have no order of their own.
    ``mode="any"``: one match is enough. Needs ``created_date_est`` on ``tags``.
    """
    spans = _spans(clean, members, order)
    if mode == "last":
        # Only the last exhibition of an object matters: one lookup row per object.
        last = spans.groupBy("refers_to_object_id").agg(
            F.max(F.struct("ordinal", F.struct("created_date_start", "created_date_end")
                           .alias("span"))).alias("last")) \
            .select("refers_to_object_id", "last.span.*")
        joined = lookup_join(tags, last, ["refers_to_object_id"])
        inside = (F.col("created_date_est") >= F.col("created_date_start")) & \
                 (F.col("created_date_est") < F.col("created_date_end"))
        return joined.withColumn("during_exhibition", F.coalesce(inside.cast("int"), F.lit(0))) \
            .drop("created_date_start", "created_date_end")
    if mode != "any":
        raise ValueError(f"mode must be 'last' or 'any', not {mode!r}")
    keys = ["refers_to_object_id", "created_date_est"]
    days = _covered_days(tags.select(*keys).filter(F.col("refers_to_object_id").isNotNull()),
                         spans)
    return lookup_join(tags, days, keys) \
        .withColumn("during_exhibition", F.coalesce(F.col("during_exhibition"), F.lit(0)))


def _covered_days(days: DataFrame, spans: DataFrame) -> DataFrame:
    """Per (object, day): is the day inside any span? The latest end among spans started so far
    tells it, so no (day, span) pairs are made. Both sides have at most one row per object and
    day before the window."""
    asked = days.select("refers_to_object_id", F.col("created_date_est").alias("day"),
                        F.lit(1).alias("asked"), F.lit(None).cast("date").alias("ends"))
    starts = spans.select("refers_to_object_id", F.col("created_date_start").alias("day"),
                          F.lit(0).alias("asked"), F.col("created_date_end").alias("ends"))
    by_day = asked.unionByName(starts).groupBy("refers_to_object_id", "day") \
        .agg(F.max("asked").alias("asked"), F.max("ends").alias("ends"))
    so_far = Window.partitionBy("refers_to_object_id").orderBy("day") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (by_day.withColumn("latest_end", F.max("ends").over(so_far))
            .filter("asked = 1")
            .select("refers_to_object_id", F.col("day").alias("created_date_est"),
                    F.coalesce((F.col("latest_end") > F.col("day")).cast("int"), F.lit(0))
                    .alias("during_exhibition")))
