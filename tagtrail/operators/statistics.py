"""Correlations, feature profiles, cluster variance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .summaries import top_per_group


def scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns centred and divided by their population standard deviation; constant columns
    become 0. One pass; two numbers per column reach the driver."""
    stats = {r["feature"]: (r["mean"], r["std"])
             for r in _per_feature(df, columns, lambda x: F.struct(
                 F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")))
             .select("feature", "value.*").collect()}
    out = {}
    for c in columns:
        mean, std = stats.get(c, (None, None))
        out[c] = (F.col(c) - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)
    return df.withColumns(out)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are known; null when either is constant there."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x))
                        * F.stddev_pop(F.when(both, y)))


def vector_columns(df: DataFrame, column: str, size: int, prefix: str = "e") -> DataFrame:
    """Array elements as columns ``e0 .. e<size-1>``."""
    return df.select("*", *[F.get(column, F.lit(i)).cast("double").alias(f"{prefix}{i}")
                            for i in range(size)])


def _per_feature(df: DataFrame, columns: Sequence[str], measure: Callable[[Column], Column],
                 group: Sequence[str] = ()) -> DataFrame:
    """(group, rows, feature, value): a measure of each column, all in one aggregate over the rows
    as they are; only its one row per group is turned into one row per feature."""
    values = {f"_{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    kept = [c for c in df.columns if c.startswith("_t_")] + list(group)
    found = df.select(*kept, *[v.alias(n) for n, v in values.items()]).groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), *[measure(F.col(n)).alias(n) for n in values])
    features = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(n).alias("value"))
                         for c, n in zip(columns, values)])
    return found.where("rows > 0").select(*group, "rows", F.explode(features).alias("f")) \
        .select(*group, "rows", "f.*")


def _correlations(df: DataFrame, target: str, columns: Sequence[str],
                  group: Sequence[str] = ()) -> DataFrame:
    held = df.withColumn("_t_", F.col(target).cast("double"))
    return _per_feature(held, columns, lambda x: pearson(x, F.col("_t_")), group) \
        .withColumnRenamed("value", "corr")


def target_correlation(df: DataFrame, target: str, columns: Sequence[str],
                       k: int = 10) -> DataFrame:
    """(feature, corr): the ``k`` features that correlate most with ``target``, itself
    included; undefined correlations come last. One pass over the rows."""
    return _correlations(df, target, columns).select("feature", "corr") \
        .orderBy(F.desc_nulls_last(F.round("corr", 9)), "feature").limit(k)


def level_correlation(sets: DataFrame, target: str, levels: str = "levels") -> DataFrame:
    """(level, corr): the Pearson correlation of each level's indicator with that of ``target``, null
    where one is constant. With n rows, b of the level, a of the target and ab of both it is
    (n ab - a b) / sqrt(a (n - a) b (n - b)): one count per level, whatever their number, and no
    column for any of them."""
    has = F.array_contains(levels, target)
    whole = sets.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(has, 1)).alias("a"))
    counts = sets.select(F.explode(levels).alias("level"), has.cast("long").alias("both")) \
        .groupBy("level").agg(F.count(F.lit(1)).alias("b"), F.sum("both").alias("ab"))
    n, a, b, ab = (F.col(c).cast("double") for c in ("n", "a", "b", "ab"))
    spread = a * (n - a) * b * (n - b)
    return counts.crossJoin(whole).select("level", F.when(  # one row
        spread > 0, (n * ab - a * b) / F.sqrt(spread)).alias("corr"))


def cluster_target_correlation(df: DataFrame, target: str, columns: Sequence[str],
                               cluster: str = "cluster", k: int = 10) -> DataFrame:
    """Per cluster its share of rows and the ``k`` features that correlate most with
    ``target`` inside it; clusters with more rows first."""
    stats = _correlations(df.withColumn("cluster", F.col(cluster)), target, columns, ["cluster"])
    # Every feature has a row per cluster, so the total is that of any one feature.
    total = F.sum("rows").over(Window.partitionBy("feature"))
    ordered = stats.withColumns({"share": F.col("rows") / total,
                                 "_order": F.coalesce(F.round("corr", 9), F.lit(-2.0))})
    return top_per_group(ordered, "cluster", "feature", "_order", k) \
        .select("cluster", "share", "feature", "corr") \
        .orderBy(F.desc("share"), "cluster", F.desc_nulls_last("corr"), "feature")


def cluster_feature_profile(df: DataFrame, columns: Sequence[str], cluster: str = "cluster",
                            k: int = 10, scale: bool = False) -> DataFrame:
    """Per cluster the ``k`` features with the highest mean (of z-scores with ``scale``).
    Means whose whole part is 1 are left out: features every row of the cluster has."""
    source = scaled(df, columns) if scale else df
    means = _per_feature(source.withColumn("cluster", F.col(cluster)), columns, F.avg, ["cluster"]) \
        .select("cluster", "feature", F.col("value").alias("mean")) \
        .filter(F.col("mean").cast("long") != 1) \
        .withColumn("_order", F.round("mean", 9))
    return top_per_group(means, "cluster", "feature", "_order", k).drop("_order")


def cluster_variance(df: DataFrame, cluster: str = "cluster",
                     features: str = "features") -> DataFrame:
    """Within-cluster, total and between-cluster sums of squares of a vector column, around
    the cluster means and the overall mean. Per-cluster moments are merged across tasks; one
    vector per cluster leaves them."""
    vec = F.col(features)
    measured = Summarizer.metrics("count", "variance").summary(vec)

    def squares(grouped, name: str) -> DataFrame:
        stats = grouped.agg(measured.alias("s"))
        spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, x: a + x)
        # The summarizer's variance divides by n - 1.
        return stats.agg(F.sum(spread * (F.col("s.count") - 1)).alias(name))

    wcss = squares(df.groupBy(cluster), "value").select(F.lit("wcss").alias("measure"), "value")
    tss = squares(df.groupBy(), "value").select(F.lit("tss").alias("measure"), "value")
    both = wcss.unionByName(tss)
    bss = both.agg(F.sum(F.when(F.col("measure") == "tss", F.col("value"))
                         .otherwise(-F.col("value"))).alias("value")) \
        .select(F.lit("bss").alias("measure"), "value")
    return both.unionByName(bss)
