"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source is a queue of its documents in shuffled order (by a hash of the id). A document's virtual
finish time is the running number of words of its source up to it, divided by the source's target;
a source whose target is above its size is passed through again, three times at most, on the same
clock. All copies are sorted by finish time over all sources and taken until the next would exceed
the budget, which is the sum of the targets.

Running sums are over a range partitioning: sums per partition first, then rows within a partition,
so a source with most of the rows is spread like any other order. Only one row per source, and one
per partition, is ever in one task.

Targets share the budget by weight; none is above ``REPEATS`` times its source's size, and the excess
is shared anew by weight. Words are runs of anything but space, tab and line ends; null text has 0.
Null is a source of its own, last in order. Documents of size 0 are taken as 0 words; repeated rows
are documents of their own; no rows give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale.durable import stored

REPEATS = 3
CYCLE = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_sum(rows: DataFrame, order: Sequence[str], value: str, to: str,
                by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row in the order ``by + order``,
    starting anew with each value of ``by``. ``by`` must not be null."""
    by, order = list(by), list(order)
    # The bounds come from a sample of the rows: written once, they stay as they are.
    dealt = stored(rows.repartitionByRange(*by, *order)
                   .withColumn("_part", F.spark_partition_id()), "ranged")
    sums = dealt.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "_part",
                         F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_part").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (dealt.join(before, [*by, "_part"])
            .withColumn(to, F.col("_before") + F.sum(value).over(within))
            .drop("_part", "_before"))


def cyclic_weights(sizes: DataFrame, cycle: Sequence[int] = CYCLE) -> DataFrame:
    """(source, source_size) with ``weight``: the cycle in order of the sources, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]),
                               (F.col("place") % len(cycle) + 1).cast("int")))


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(place, source, source_size, weight) with ``target``. In order of the most that a source can
    give per unit of weight, the sources up to some point give all they can, and the rest share
    what is left by weight; the point is the first where the next source can give its share."""
    most = F.col("source_size") * repeats
    whole = Window.partitionBy()
    order = Window.orderBy("_ratio", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    leveled = (sources.withColumn("_most", most.cast("double"))
               .withColumn("_ratio", F.col("_most") / F.col("weight"))
               .withColumn("_left", F.sum("source_size").over(whole)
                           - F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
               .withColumn("_weights", F.sum("weight").over(whole)
                           - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
               .withColumn("_level", F.col("_left") / F.col("_weights"))
               .withColumn("_first", F.min(F.when(F.col("_ratio") >= F.col("_level"),
                                                  F.struct("_ratio", "place", "_level"))).over(whole)))
    return leveled.withColumn("target", F.coalesce(
        F.least(F.col("_most"), F.col("weight") * F.col("_first._level")), F.col("_most"))) \
        .select("place", "source", "source_size", "weight", "target")


def mix(documents: DataFrame, repeats: int = REPEATS, cycle: Sequence[int] = CYCLE) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, finish), a row per row of
    ``documents``: how often the mix holds it, the words that makes, and the virtual time of its
    first copy, which is the order of the mix. Passes are one unit of virtual time times
    source_size / target apart."""
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(cyclic_weights(sizes, cycle), repeats), "sources")
    known = sized.join(sources.withColumnRenamed("source", "_source"),
                       F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    queued = stored(running_sum(known.withColumn("_shuffled", F.xxhash64("doc_id", F.lit("mix"))),
                                ["_shuffled", "doc_id", "size"], "size", "_upto", ["place"]),
                    "queued")
    # Copies that start before their source has its target; the last of a source may pass it.
    passes = F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)),
                      lambda r: r * F.col("source_size") + F.col("_upto") - F.col("size")
                      < F.col("target"))
    copies = queued.select("doc_id", "place", "size", "source_size", "target", "_upto",
                           F.explode(passes).alias("_pass")) \
        .withColumn("_finish", _finish(F.col("_pass")))
    ranked = running_sum(copies, ["_finish", "place", "_upto", "doc_id", "_pass"], "size", "_all")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    last = ranked.where(F.col("_all") <= budget).agg(
        F.max(F.struct("_finish", "place", "_upto")).alias("at")).first()["at"]  # one row
    if last is None:
        kept = F.lit(0)
    else:
        end = F.struct(F.lit(last["_finish"]).alias("_finish"), F.lit(last["place"]).alias("place"),
                       F.lit(last["_upto"]).alias("_upto"))
        kept = F.size(F.filter(passes, lambda r: F.struct(
            _finish(r).alias("_finish"), "place", "_upto") <= end))
    return queued.select(
        "doc_id", "source", "size", "source_size", "target", kept.cast("long").alias("copies"),
        (kept * F.col("size")).cast("long").alias("taken"), _finish(F.lit(0)).alias("finish"))


def _finish(turn: Column) -> Column:
    return F.when(F.col("target") > 0,
                  (turn * F.col("source_size") + F.col("_upto")) / F.col("target"))
