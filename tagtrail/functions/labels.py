"""Display labels and text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAY_NAMES = ["Mon", "Tues", "Wed", "Thurs", "Fri", "Sat", "Sun"]
EXHIBITION_NAMES = ["non-exhibitions", "exhibitions"]
CLOSING_NAMES = ["open hours", "after hours"]


def _pick(names: list[str], index: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def month_name(month: Column) -> Column:
    return _pick(MONTH_NAMES, month)


def weekday_name(dow: Column) -> Column:
    return _pick(WEEKDAY_NAMES, dow + 1)


def exhibition_name(flag: Column) -> Column:
    return _pick(EXHIBITION_NAMES, flag + 1)


def closing_name(flag: Column) -> Column:
    return _pick(CLOSING_NAMES, flag + 1)


def hour_label(hour: Column) -> Column:
    """9 -> 9am, 12 -> 12pm, 15 -> 3pm."""
    text = F.when(hour > 12, hour - 12).otherwise(hour).cast("string")
    return F.concat(text, F.when(hour < 12, "am").otherwise("pm"))


def room_name_of_spot(name: Column) -> Column:
    """First all-digit part of a comma list, otherwise its last part."""
    parts = F.transform(F.split(name, ","), lambda s: F.trim(s))
    numbers = F.filter(parts, lambda s: s.rlike("^[0-9]+$"))
    return F.coalesce(F.get(numbers, F.lit(0)), F.element_at(parts, -1))


def spot_label(name: Column) -> Column:
    """Text after the second comma, further commas removed."""
    return F.trim(F.array_join(F.slice(F.split(name, ","), 3, 2 ** 30), ""))
