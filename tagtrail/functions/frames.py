"""Column selection and naming by pattern or type."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def sanitize_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def columns_of_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def drop_time_columns(df: DataFrame) -> DataFrame:
    """Keep the flat columns only: dates and timestamps go."""
    return df.drop(*columns_of_type(df, T.DateType, T.TimestampType, T.TimestampNTZType))


# Name patterns and members of the feature groups.
GROUP_PATTERNS = {"turnover": "_freq", "capacity": "_cap", "floor": "floor_", "room": "room_",
                  "quarter": "quarter_", "month": "month_", "year": "year_", "wom": "wom_"}
GROUP_MEMBERS = {
    "days": ["Mon", "Tues", "Wed", "Thur", "Fri", "weekend"],
    "time_of_day": ["pre-morning", "morning", "afternoon", "evening", "night",
                    "tagged_after_close"],
    "events": ["is_bursty", "during_exhibition", "visitor_drawn", "meta_store"],
}


def feature_groups(columns: list[str]) -> dict[str, list[str]]:
    groups = {name: [c for c in columns if part in c] for name, part in GROUP_PATTERNS.items()}
    groups.update({name: [m for m in members if m in columns]
                   for name, members in GROUP_MEMBERS.items()})
    return groups


def room_renames(columns: list[str], room_names: dict[int, str]) -> dict[str, str]:
    """``room_<id>`` indicator columns to ``rm_<room name>``; bins and the "no metadata" marker
    keep their names. ``room_names`` holds the rooms that have a column, so it is as small as
    the column list."""
    out = {}
    for column in columns:
        match = re.fullmatch(r"room_(\d+)", column)
        if match and match.group(1) != "9999" and int(match.group(1)) in room_names:
            out[column] = "rm_" + room_names[int(match.group(1))]
    return out
