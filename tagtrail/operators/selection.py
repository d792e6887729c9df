"""Exact ranks, percentiles and samples of any number of values.

Values are range-partitioned and the partitions counted; only those that hold a wanted rank are looked
at again. One number per partition and one value per rank reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale.durable import release, stored


class Ranked:
    """The values of a column that are not null, in order."""

    def __init__(self, df: DataFrame, column: str):
        values = df.select(F.col(column).alias("value")).where("value IS NOT NULL")
        self._dealt = stored(values.repartitionByRange("value")
                             .withColumn("part", F.spark_partition_id()), "ranks")
        self._before, total = {}, 0
        for row in self._dealt.groupBy("part").count().orderBy("part").collect():
            self._before[row["part"]] = total
            total += row["count"]
        self.count = total

    def at(self, ranks: Iterable[int]) -> dict[int, object]:
        """The values at some ranks, from 0."""
        wanted: dict[int, list[int]] = {}
        for rank in set(ranks):
            if not 0 <= rank < self.count:
                raise IndexError(f"rank {rank} of {self.count}")
            part = max(p for p, before in self._before.items() if before <= rank)
            wanted.setdefault(part, []).append(rank - self._before[part])
        found = {}
        for part, places in wanted.items():
            place = F.row_number().over(Window.orderBy("value")) - 1
            rows = self._dealt.where(F.col("part") == part).select("value", place.alias("place")) \
                .where(F.col("place").isin(places)).collect()
            found.update({r["place"] + self._before[part]: r["value"] for r in rows})
        return found

    def release(self) -> None:
        release(self._dealt)


def distinct_percentiles(df: DataFrame, column: str, percents: Sequence[float],
                         skip: int = 0) -> list[float | None]:
    """Linearly interpolated percentiles of the distinct values of a column, without the ``skip``
    smallest; None where no value is left."""
    ranked = Ranked(df.select(column).distinct(), column)
    n = ranked.count - skip
    if n <= 0:
        return [None] * len(percents)
    at = {p: (n - 1) * (p / 100.0) for p in percents}
    found = ranked.at(skip + r for x in at.values() for r in (math.floor(x), math.ceil(x)))
    ranked.release()
    out = []
    for p in percents:
        low, high = (float(found[skip + f(at[p])]) for f in (math.floor, math.ceil))
        out.append(low + (high - low) * (at[p] - math.floor(at[p])))
    return out


def spread_key(key: Column, salt: str = "") -> Column:
    """A digest of a key, the same in any engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary"))


def sampled_rows(df: DataFrame, key: str, fraction: float | None = None, rows: int | None = None,
                 salt: str = "") -> DataFrame:
    """A random sample of an exact size: the rows with the smallest digests of ``key``, which is
    unique. Samples of parts merge, repeat from run to run, and a smaller one lies in a larger one.
    Rows whose key is null are never drawn."""
    digest = df.select(spread_key(F.col(key), salt).alias("digest"))
    ranked = Ranked(digest, "digest")
    if rows is None:
        rows = round(ranked.count * fraction)
    rows = min(rows, ranked.count)
    if rows <= 0:
        return df.limit(0)
    last = ranked.at([rows - 1])[rows - 1]
    ranked.release()
    return df.where(spread_key(F.col(key), salt) <= F.lit(last))
