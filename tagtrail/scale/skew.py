"""Joins of a large table to a lookup with unique keys, at any size of either.

The plan is left to Spark: a lookup whose size, as the shuffle wrote it, is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` is sent to all tasks; otherwise the join shuffles,
and adaptive execution splits partitions of the large side that a frequent key has made too big,
however many such keys there are. The join therefore has to be the first thing that asks for the
rows of a key together; operators that aggregate by the key do so before or after, not on top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(big: DataFrame, lookup: DataFrame, keys: Sequence[str],
                how: str = "left") -> DataFrame:
    """Join ``big`` to ``lookup`` (at most one row per key) on ``keys``."""
    return big.join(lookup, list(keys), how)
