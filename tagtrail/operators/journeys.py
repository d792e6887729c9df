"""Daily visitor journeys (D06), ten-minute counts (W06) and bursts.

A journey holds one object per second, so however many rows a visitor has, a journey has at most
90,000 steps (a 25-hour day). The collapse to one row per second is a pre-aggregated group-by;
windows and arrays per journey come after it and are therefore bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..schemas import NO_META
from ..scale.skew import lookup_join
from .times import wall_tags

JOURNEY = ["bundle_id", "created_date_est"]
BUCKET_SECONDS = 600


def packing(tags: DataFrame) -> int | None:
    """How many bits an object needs where the id of a tag and its object fit into one long together,
    neither of them negative and no id null; else None."""
    types = dict(tags.dtypes)
    if any(types[c] not in ("int", "bigint") for c in ("id", "refers_to_object_id")):
        return None
    low, high, least, most, missing = tags.agg(
        F.min("id"), F.max("id"), F.min("refers_to_object_id"), F.max("refers_to_object_id"),
        F.count_if(F.col("id").isNull())).first()
    if missing or low is None or least is None or low < 0 or least < 0:
        return None
    return most.bit_length() if high.bit_length() + most.bit_length() <= 63 else None


def journey_steps(tags: DataFrame, bits: int | None = None) -> DataFrame:
    """(bundle, local date, second, object) of wall tags; of several tags in one second the
    last by id (then by object) stays. With ``bits`` of ``packing`` that is the largest of one number, so
    that rows are hashed and not sorted."""
    if bits is not None:
        wall = wall_tags(tags).filter(F.col("bundle_id").isNotNull())
        kind = tags.schema["refers_to_object_id"].dataType
        last = wall.groupBy("bundle_id", "created").agg(F.max(
            F.shiftleft(F.col("id").cast("long"), bits).bitwiseOR(F.col("refers_to_object_id").cast("long")))
            .alias("last"))
        return last.select("bundle_id", cal.local_date(F.col("created")).alias("created_date_est"), "created",
                           F.col("last").bitwiseAND((1 << bits) - 1).cast(kind).alias("refers_to_object_id"))
    return (wall_tags(tags).filter(F.col("bundle_id").isNotNull())
            .groupBy("bundle_id", cal.local_date(F.col("created")).alias("created_date_est"),
                     "created")
            .agg(F.max_by("refers_to_object_id", F.struct("id", "refers_to_object_id"))
                 .alias("refers_to_object_id")))


def bundle_journeys(tags: DataFrame) -> DataFrame:
    """One row per journey: steps ordered in time, and the object ids alone."""
    step = F.struct("created", F.col("refers_to_object_id").alias("object_id"))
    return (journey_steps(tags).groupBy(*JOURNEY)
            .agg(F.array_sort(F.collect_list(step)).alias("steps"))
            .withColumn("object_ids", F.transform("steps", lambda s: s["object_id"])))


def journey_starts(tags: DataFrame) -> DataFrame:
    """First object of each journey."""
    return journey_steps(tags).groupBy(*JOURNEY) \
        .agg(F.min_by("refers_to_object_id", "created").alias("object_id"))


def transitions(tags: DataFrame, bits: int | None = None) -> DataFrame:
    """(src, dst) of consecutive steps of a journey, with repeats; ``bits`` as in ``journey_steps``."""
    along = Window.partitionBy(*JOURNEY).orderBy("created")
    return (journey_steps(tags, bits)
            .select(F.col("refers_to_object_id").alias("src"),
                    F.lead("refers_to_object_id").over(along).alias("dst"))
            .filter(F.col("dst").isNotNull()))


def bucket_counts(tags: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Steps per journey and time bucket; empty buckets are absent. Journeys are brought
    together before the count (they are bounded), so neither it nor a window per journey
    after it shuffles again."""
    return journey_steps(tags).repartition(*JOURNEY) \
        .groupBy(*JOURNEY, F.floor(F.col("created") / seconds).alias("bucket")) \
        .agg(F.count(F.lit(1)).alias("n"))


def resampled_counts(tags: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Zero-filled counts from a journey's first to its last bucket, with the two-point rolling
    mean (null in the first bucket). At 600 s a journey has at most 151 buckets."""
    counts = bucket_counts(tags, seconds)
    # Each bucket also answers for the empty ones up to the next: no grid is joined.
    along = Window.partitionBy(*JOURNEY).orderBy("bucket")
    until = F.coalesce(F.lead("bucket").over(along) - 1, F.col("bucket"))
    filled = (counts.withColumn("until", until)
              .select(*JOURNEY, F.col("bucket").alias("first"), "n",
                      F.explode(F.sequence("bucket", "until")).alias("bucket"))
              .select(*JOURNEY, "bucket",
                      F.when(F.col("bucket") == F.col("first"), F.col("n")).otherwise(0)
                      .alias("n")))
    return filled.withColumn("rolling_mean", (F.col("n") + F.lag("n").over(along)) / 2)


def burst_anomalies(tags: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Per journey: number of steps and number of buckets whose count exceeds the rolling mean
    by more than three population standard deviations of that mean.

    Empty buckets are never bursts and add zeros or half their neighbour to the rolling mean, so
    they are accounted for without being made. With s = sum of two adjacent buckets, M windows
    and d = count minus the bucket before, ``count > mean + 3 std`` is
    ``d > 0 and d*d*M*M > 9*(M*sum(s*s) - sum(s)^2)``: whole numbers, so nothing hangs on
    rounding at the threshold.
    """
    along = Window.partitionBy(*JOURNEY).orderBy("bucket")
    whole = Window.partitionBy(*JOURNEY)
    n = F.col("n")
    placed = bucket_counts(tags, seconds).withColumns({
        "gap": F.col("bucket") - F.lag("bucket").over(along),
        "before": F.lag("n").over(along),
        "last": F.lead("bucket").over(along).isNull(),
    })
    # Window sums that end in this bucket, and in the empty bucket right after the one before.
    before = F.when(F.col("gap") == 1, F.col("before")).otherwise(0)
    here = F.when(F.col("gap").isNotNull(), n + before).otherwise(0)
    trailing = F.when(F.col("gap") > 1, F.col("before")).otherwise(0)
    sums = placed.select(
        *JOURNEY, n, (n - before).alias("rise"), F.col("gap"),
        (F.max("bucket").over(whole) - F.min("bucket").over(whole)).alias("m"),
        F.sum(here + trailing).over(whole).alias("s1"),
        F.sum(here * here + trailing * trailing).over(whole).alias("s2"))
    burst = F.col("gap").isNotNull() & (F.col("rise") > 0) & (
        F.col("rise") * F.col("rise") * F.col("m") * F.col("m")
        > 9 * (F.col("m") * F.col("s2") - F.col("s1") * F.col("s1")))
    return sums.groupBy(*JOURNEY).agg(
        F.sum("n").alias("n_obs"),
        F.sum(F.coalesce(burst.cast("long"), F.lit(0))).alias("n_anomalies"))


def bursty_tags(tags: DataFrame, bursts: DataFrame) -> DataFrame:
    """Tags with the burst counts of their journey; tags without a journey get the marker.
    Needs ``created_date_est`` on ``tags``."""
    joined = lookup_join(tags, bursts, JOURNEY)
    return joined.fillna(NO_META, ["n_obs", "n_anomalies"]) \
        .withColumn("bursty", (F.col("n_anomalies") > 0).cast("int"))
