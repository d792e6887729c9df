"""Cosine similarity of objects by their metadata levels.

An object is the set of the levels it has in a few columns; the similarity of two is the number of
levels they share over the root of the product of their sizes. The index holds, for every combination
of levels and size of set, the ``n + 1`` smallest ids that have it. The best ``n`` others of an object
are all in it: one that shares exactly the combination S with the object is either in the list of S and
of its size, or that list has ``n + 1`` smaller ids of the same size that share at least as much, and
then it is not among the best. So work grows with the objects, a frequent level is one list of ``n + 1``
ids, and no pair of objects is looked at beyond those lists. Only the ``n + 1`` smallest ids of a set of
levels enter the index, as the rest are in no list; combinations are made of them alone. Objects with the same levels are one
profile when they look up; the index is written before the look-up, so that joins to it can be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale.durable import buckets, stored
from .summaries import top_per_group

MOST_COLUMNS = 8


def _combinations(rows: DataFrame, levels: Sequence[str], *kept: str) -> DataFrame:
    """A row for each set of levels that a row has, none left out but the empty one: how many they
    are, and the levels as JSON under nulls for the columns not taken."""
    taken = []
    for mask in range(1, 1 << len(levels)):
        inside = [bool(mask >> i & 1) for i in range(len(levels))]
        has_all = F.lit(True)
        for c, i in zip(levels, inside):
            has_all = has_all & F.col(c).isNotNull() if i else has_all
        text = F.to_json(F.array(*[F.col(c) if i else F.lit(None).cast("string")
                                   for c, i in zip(levels, inside)]))
        taken.append(F.when(has_all, F.struct(F.lit(sum(inside)).alias("shared"),
                                              text.alias("combination"))))
    return rows.select(*kept, F.explode(F.array_compact(F.array(*taken))).alias("taken")) \
        .select(*kept, "taken.*")


def object_similarity(objects: DataFrame, key: str, columns: Sequence[str], n: int = 10) -> DataFrame:
    """(id, other, similarity): for each object the ``n`` most similar others that share a level with
    it, exactly; ties go to the lower id. Null is no level. Keys are unique."""
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"combinations of at most {MOST_COLUMNS} columns are indexed")
    levels = [f"level{i}" for i in range(len(columns))]
    rows = objects.select(F.col(key).alias("id"),
                          *[F.col(c).cast("string").alias(to) for c, to in zip(columns, levels)])
    size = sum((F.col(c).isNotNull().cast("int") for c in levels), F.lit(0))
    # A small file would be one task, with all the combinations of all objects.
    rows = stored(rows.withColumn("size", size).where("size > 0")
                  .repartition(buckets(objects.sparkSession), "id"), "levels")
    # What is not among the smallest ids of its profile is not among those of any combination.
    least = Window.partitionBy(*levels, "size").orderBy("id")
    first = rows.withColumn("k", F.row_number().over(least)).where(F.col("k") <= n + 1).drop("k")
    order = Window.partitionBy("combination", "size").orderBy("id")
    index = _combinations(first, levels, "id", "size").withColumn("k", F.row_number().over(order)) \
        .where(F.col("k") <= n + 1).groupBy("combination", "size") \
        .agg(F.collect_list("id").alias("ids"))
    index = stored(index.groupBy("combination")
                   .agg(F.collect_list(F.struct("size", "ids")).alias("by_size")), "level-index")
    # The profile's own smallest id is its name.
    profiles = stored(rows.groupBy(*levels, "size").agg(F.min("id").alias("profile")), "profiles")
    asked = _combinations(profiles, levels, "profile", "size").withColumnRenamed("size", "own")
    met = asked.join(index, "combination") \
        .select("profile", "own", "shared", F.explode("by_size").alias("s")) \
        .select("profile", F.round(F.col("shared") / F.sqrt(
            (F.col("own") * F.col("s.size")).cast("double")), 12).alias("similarity"),
                F.explode("s.ids").alias("other"))
    # An object is met once for each combination that both have; the largest is all they share.
    best = met.groupBy("profile", "other").agg(F.max("similarity").alias("similarity"))
    best = top_per_group(best, "profile", "other", "similarity", n + 1) \
        .groupBy("profile").agg(F.sort_array(F.collect_list(
            F.struct((-F.col("similarity")).alias("less"), "other"))).alias("best"))
    named = stored(profiles.join(best, "profile"), "best")
    same = [rows[c].eqNullSafe(named[c]) for c in levels]
    others = F.slice(F.filter("best", lambda b: b["other"] != F.col("id")), 1, n)
    return rows.join(named, same).select(rows["id"], F.explode(others).alias("b")) \
        .select("id", "b.other", (-F.col("b.less")).alias("similarity"))
