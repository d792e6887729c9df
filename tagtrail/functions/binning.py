"""Right-closed bins and indicator columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours of the day; hour 0 belongs to no bin.
HOUR_EDGES = [0, 10, 12, 17, 20, 24]
HOUR_LABELS = ["pre-morning", "morning", "afternoon", "evening", "night"]

# Location bins; the first takes the "no metadata" marker.
ROOM_LABELS = ["room_nometa", "room_small_cap", "room_midsize_cap", "room_large_cap",
               "room_xlarge_cap"]
ROOM_PERCENTS = [70, 85, 90, 95]
SPOT_LABELS = ["spot_nometa", "spot_constant_freq", "spot_normal_freq", "spot_high_freq",
               "spot_dynamic_freq"]
SPOT_PERCENTS = [50, 90, 95, 100]
BIN_FLOOR = [-10000, 0]


def right_closed(value: Column, edges: Sequence[Column | float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]`` that holds ``value``; null outside all bins."""
    edges = [e if isinstance(e, Column) else F.lit(e) for e in edges]
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((value > low) & (value <= high), F.lit(label)).otherwise(out)
    return out


def hour_bin(hour: Column) -> Column:
    return right_closed(hour, HOUR_EDGES, HOUR_LABELS)


def indicator(condition: Column) -> Column:
    """0/1 integer; a null condition counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))
