"""Calendar columns from epoch seconds.

Everything is computed on zone-free timestamps, so results do not depend on the
session time zone. Epoch seconds are UTC; "local" is the museum's wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "US/Eastern"

# Closing times in seconds of the local day; Saturday stays open longer.
CLOSE_SECONDS = 18 * 3600
SATURDAY_CLOSE_SECONDS = 21 * 3600
SATURDAY = 5


def utc_time(epoch: Column) -> Column:
    return F.timestamp_add("SECOND", epoch, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def local_time(epoch: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock in ``zone``. The two 01:00 hours of an autumn clock change coincide here;
    group by a UTC column where they must stay apart."""
    # A zone given as a literal is looked up once, by ``convert_timezone`` for every row.
    return utc_time(F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)))


def utc_date(epoch: Column) -> Column:
    return utc_time(epoch).cast("date")


def local_date(epoch: Column, zone: str = LOCAL_ZONE) -> Column:
    return local_time(epoch, zone).cast("date")


def hour_start(epoch: Column) -> Column:
    """Epoch second at which the UTC hour of ``epoch`` began."""
    return epoch - F.pmod(epoch, F.lit(3600))


def monday_weekday(day: Column) -> Column:
    """Monday 0 .. Sunday 6."""
    return F.weekday(day)


def weekend(day: Column) -> Column:
    return (F.weekday(day) > 4).cast("int")


def week_of_month(day_of_month: Column) -> Column:
    return F.least(F.floor(day_of_month / 7).cast("int") + 1, F.lit(4))


def seconds_of_day(wall: Column) -> Column:
    return F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)


def after_close(wall: Column) -> Column:
    """1 when the wall-clock time is strictly after that day's closing time."""
    closes = F.when(F.weekday(wall.cast("date")) == SATURDAY, SATURDAY_CLOSE_SECONDS) \
        .otherwise(CLOSE_SECONDS)
    return (seconds_of_day(wall) > closes).cast("int")


def parse_day(text: Column) -> Column:
    """``yyyy-MM-dd`` text to a date; impossible dates such as 0000-00-00 give null."""
    return F.try_to_date(text, "yyyy-MM-dd")


def day_gap(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))
