"""Calendar features of the tag log (D01, D02) and the wall/visitor split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal

CALENDAR = ["month", "year", "day", "dow", "week", "weekend", "hour", "quarter"]


def with_times(tags: DataFrame, zone: str = cal.LOCAL_ZONE) -> DataFrame:
    """UTC and local time columns of ``created``."""
    created = F.col("created")
    hour = cal.hour_start(created)
    return tags.withColumns({
        "created_dateformat": cal.utc_time(created),
        "created_date": cal.utc_date(created),
        "created_dateformat_utc": cal.utc_time(created),
        "created_dateformat_est": cal.local_time(created, zone),
        "created_date_est": cal.local_date(created, zone),
        "created_dateformat_hr_utc": cal.utc_time(hour),
        "created_dateformat_hr_est": cal.local_time(hour, zone),
    })


def with_calendar(tags: DataFrame) -> DataFrame:
    """Parts of the local date and time."""
    wall, day = F.col("created_dateformat_est"), F.col("created_date_est")
    return tags.withColumns({
        "month": F.month(day), "year": F.year(day), "day": F.day(day),
        "dow": cal.monday_weekday(day), "week": F.weekofyear(day), "weekend": cal.weekend(day),
        "hour": F.hour(wall), "quarter": F.quarter(day),
    })


def tag_time_features(tags: DataFrame) -> DataFrame:
    """Raw log to log with time columns, calendar parts and the visitor-drawn flag."""
    return with_calendar(with_times(tags)) \
        .withColumn("visitor_drawn", (F.col("tool_id") != 0).cast("int"))


def closing_time_flag(tags: DataFrame) -> DataFrame:
    """Add ``tagged_after_close``; needs ``created_dateformat_est``."""
    return tags.withColumn("tagged_after_close",
                           cal.after_close(F.col("created_dateformat_est")))


def wall_tags(tags: DataFrame) -> DataFrame:
    return tags.filter((F.col("tool_id") == 0) & (F.col("refers_to_object_id") != 0))


def visitor_created(tags: DataFrame) -> DataFrame:
    return tags.filter(F.col("tool_id") != 0)
