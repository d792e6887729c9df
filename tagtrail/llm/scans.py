"""Running sums and exclusive-ors along ordered groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale.durable import stored


def dealt(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` written in a range partitioning by ``by`` and ``order``, with the partition as
    ``_part``: a large group lies in several partitions, in order."""
    # The bounds come from a sample of the rows: written once, they stay as they are.
    return stored(rows.repartitionByRange(*by, *order)
                  .withColumn("_part", F.spark_partition_id()), "ranged")


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str],
            parts: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` as ``dealt`` gives them, with a column per entry of ``parts``: the "sum" or "xor" of
    a column over the rows of the group up to and with each row. Per partition first, then within
    it: no task ever sees a whole group. ``by`` must not be null."""
    folds = {"sum": F.sum, "xor": F.bit_xor}
    made = {name: (folds[kind], kind, column) for name, (kind, column) in parts.items()}
    sums = rows.groupBy(*by, "_part").agg(
        *[fold(column).alias(f"_{name}") for name, (fold, _, column) in made.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "_part", *[
        F.coalesce(fold(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}")
        for name, (fold, _, _) in made.items()])
    within = Window.partitionBy(*by, "_part").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(before, [*by, "_part"])
    for name, (fold, kind, column) in made.items():
        here, there = fold(column).over(within), F.col(f"_{name}")
        out = out.withColumn(name, there + here if kind == "sum" else there.bitwiseXOR(here))
    return out.drop("_part", *[f"_{name}" for name in made])
