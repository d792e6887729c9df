"""PageRank and what is read off it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..scale.durable import release, stored
from .graph import Adjacency, endpoints
from .summaries import share, top_per_group

def _with_out_degree(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree); 0 for vertices without outgoing edges."""
    rows = ids.select("id", F.lit(0).alias("n")) \
        .unionByName(edges.select(F.col("src").alias("id"), F.lit(1).alias("n")))
    return rows.groupBy("id").agg(F.sum("n").alias("out_degree"))


def _round(along: Adjacency, state: DataFrame, base: float, damping: float) -> DataFrame:
    """One round: ``base + damping * sum(rank / out_degree)``. Each vertex also sends itself a
    message of no weight, so that those without incoming edges, the out-degrees and the ranks so
    far (``old``) come along in the one group-by and no join is needed for them."""
    sent = along.send(state.filter("out_degree > 0"), "pagerank / out_degree", "share")
    own = state.selectExpr("id", "out_degree", "pagerank AS old", "0.0D AS share")
    return sent.selectExpr("dst AS id", "CAST(NULL AS BIGINT) AS out_degree",
                           "CAST(NULL AS DOUBLE) AS old", "share") \
        .union(own).groupBy("id") \
        .agg(F.expr("max(out_degree) AS out_degree"), F.expr("max(old) AS old"),
             F.expr(f"{base!r}D + {damping!r}D * sum(share) AS pagerank"))


def _change(state: DataFrame) -> tuple[float, float]:
    """Largest and total rank difference of the last round."""
    moved = F.abs(F.col("pagerank") - F.col("old"))
    row = state.agg(F.max(moved).alias("most"), F.sum(moved).alias("all")).first()
    return row["most"] or 0.0, row["all"] or 0.0


def pagerank(vertices: DataFrame, edges: DataFrame, reset: float = 0.15, tol: float = 0.01,
             iterations: int | None = None) -> DataFrame:
    """Vertices with ``pagerank = reset + (1 - reset) * sum(rank / out_degree)`` over incoming
    edges, started at 1. Runs ``iterations`` rounds, or until no rank moves by more than
    ``tol``. Vertices without incoming edges end at ``reset``. The ends of ``edges`` must be
    among the vertices."""
    state = stored(_with_out_degree(vertices, edges).withColumn("pagerank", F.lit(1.0)), "ranks")
    along = Adjacency(edges)
    rounds = count() if iterations is None else range(iterations)
    for _ in rounds:
        before, state = state, stored(_round(along, state, reset, 1 - reset), "ranks")
        release(before)
        if iterations is None and _change(state)[0] <= tol:
            break
    return vertices.join(state.select("id", "pagerank"), "id")


def pagerank_normalized(edges: DataFrame, damping: float = 0.85, tol: float = 1e-6,
                        iterations: int | None = None) -> DataFrame:
    """(id, pagerank) over the edge endpoints, summing to 1: rank of vertices without outgoing
    edges is spread evenly. Highest first."""
    edges = edges.select("src", "dst").dropDuplicates()
    fixed = stored(_with_out_degree(endpoints(edges), edges), "degrees")
    n = fixed.count()
    if n == 0:
        return fixed.select("id", F.lit(0.0).alias("pagerank"))
    along = Adjacency(edges)
    state = fixed.withColumn("pagerank", F.lit(1.0 / n))
    for _ in count() if iterations is None else range(iterations):
        loose = state.filter("out_degree = 0").agg(F.sum("pagerank").alias("s")).first()["s"]
        before, state = state, stored(
            _round(along, state, (1 - damping + damping * (loose or 0.0)) / n, damping), "ranks")
        release(before)
        if iterations is None and _change(state)[1] < n * tol:
            break
    return state.select("id", "pagerank").orderBy(F.desc("pagerank"), "id")


def ranked(ranks: DataFrame, k: int = 10, tier: str = "top", places: int = 9) -> DataFrame:
    """The ``k`` highest (or, for ``tier="bottom"``, lowest) ranks. Ranks equal to ``places``
    decimals are ordered by id, so that the choice does not hang on summation order."""
    rank = F.round("pagerank", places)
    order = [F.desc(rank), F.asc("id")] if tier == "top" else [F.asc(rank), F.desc("id")]
    return ranks.orderBy(*order).limit(k)


def pagerank_topk(ranks: DataFrame, k: int = 10) -> DataFrame:
    return ranked(ranks, k).select("id", "department", "type", "pagerank")


def inspect_pagerank(loctypes: DataFrame, ranks: DataFrame, k: int = 10) -> DataFrame:
    """Location and type rows of the ``k`` highest ranked vertices (``k`` rows are broadcast)."""
    top = ranked(ranks, k).select("id", "department", "pagerank")
    return loctypes.join(F.broadcast(top), "id").orderBy(F.desc("pagerank"), "id")


def influential_tags(ranks: DataFrame, tags: DataFrame, k: int = 10,
                     tier: str = "top") -> DataFrame:
    """Tags on the ``k`` chosen vertices (``k`` rows are broadcast)."""
    chosen = ranked(ranks, k, tier).select(F.col("id").alias("refers_to_object_id"))
    return tags.join(F.broadcast(chosen), "refers_to_object_id")


PERIODS = ["year", "hour", "quarter", "weekend"]


def influence_report(ranks: DataFrame, tags: DataFrame, k: int = 10, tier: str = "top",
                     top: int = 5) -> DataFrame:
    """(measure, item, value) rows: number and shares of tags on the chosen vertices, of those
    during exhibitions and after closing, and the most frequent values of each period column.

    One scan: the log is counted by its flags and periods, marked by whether the object is
    among the chosen."""
    chosen = ranked(ranks, k, tier).select(F.col("id").alias("refers_to_object_id"),
                                           F.lit(True).alias("chosen"))
    one = F.lit(1)
    columns = ["during_exhibition", "tagged_after_close", *PERIODS]
    counts = stored(tags.select("refers_to_object_id", *columns)
                 .join(F.broadcast(chosen), "refers_to_object_id", "left")
                 .groupBy(F.coalesce("chosen", F.lit(False)).alias("chosen"), *columns)
                 .agg(F.count(one).alias("n")))
    hit = F.col("chosen")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tags"), total(hit).alias("hits"),
                      total(hit & (F.col("during_exhibition") == 1)).alias("shown"),
                      total(hit & (F.col("tagged_after_close") == 1)).alias("late"))
    shown = F.col("shown")
    figures = sums.select(
        F.col("hits").cast("double").alias("n_tags"),
        share(F.col("hits"), F.col("tags")).alias("share_of_tags"),
        shown.cast("double").alias("n_exhibition_tags"),
        share(shown, F.col("hits")).alias("exhibition_share_of_influential"),
        share(shown, F.col("tags")).alias("exhibition_share_of_tags"),
        F.col("late").cast("double").alias("n_after_close_tags"))
    report = figures.unpivot([], figures.columns, "measure", "value") \
        .select("measure", F.lit("").alias("item"), "value")
    periods = counts.filter(hit).unpivot(["n"], [F.col(p).cast("int").alias(p) for p in PERIODS],
                                         "measure", "item") \
        .filter(F.col("item").isNotNull()) \
        .groupBy("measure", "item").agg(F.sum("n").alias("n"))
    best = top_per_group(periods, "measure", "item", "n", top)
    return report.unionByName(best.select(
        "measure", F.col("item").cast("string").alias("item"),
        F.col("n").cast("double").alias("value")))


def influence_activity(tags: DataFrame) -> DataFrame:
    """Influential tags by month, weekday and hour (10..21), labelled, in calendar order."""
    counts = tags.groupBy("month", "dow", "hour").agg(F.count(F.lit(1)).alias("n")) \
        .unpivot(["n"], ["month", "dow", "hour"], "period", "position") \
        .filter((F.col("period") != "hour") | F.col("position").between(10, 21)) \
        .groupBy("period", "position").agg(F.sum("n").alias("n_tags"))
    at = F.col("position")
    label = F.when(F.col("period") == "month", labels.month_name(at)) \
        .when(F.col("period") == "dow", labels.weekday_name(at)) \
        .otherwise(labels.hour_label(at))
    return counts.withColumn("label", label).orderBy("period", "position")


def transition_counts(ranks: DataFrame, edges: DataFrame, direction: str = "in",
                      k: int = 10, top: int = 10) -> DataFrame:
    """(influence_id, influence_type, type, n): most frequent types of the neighbours of the
    ``k`` highest ranked vertices, on incoming or outgoing edges."""
    near, far = {"in": ("dst", "src"), "out": ("src", "dst")}[direction]
    chosen = ranked(ranks, k).select(F.col("id").alias("influence_id"),
                                     F.col("type").alias("influence_type"))
    # At most k edges per neighbour remain, so no neighbour is frequent in the second join.
    around = edges.select(F.col(near).alias("influence_id"), F.col(far).alias("id")) \
        .join(F.broadcast(chosen), "influence_id")
    counts = around.join(ranks.select("id", "type"), "id") \
        .groupBy("influence_id", "influence_type", "type").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, ["influence_id", "influence_type"], "type", "n", top)


def transition_types(ranks: DataFrame, edges: DataFrame, direction: str = "in", k: int = 10,
                     top: int = 10) -> DataFrame:
    """One row per influential vertex, with its neighbour types as a list of (type, n)."""
    counts = transition_counts(ranks, edges, direction, k, top)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "type", "n")))
    lists = counts.groupBy("influence_id").agg(F.transform(
        ordered, lambda s: F.struct(s["type"].alias("type"), s["n"].alias("count")))
        .alias("transition_types"))
    chosen = ranked(ranks, k).select(F.col("id").alias("influence_id"),
                                     F.col("type").alias("influence_type"))
    return chosen.join(lists, "influence_id", "left")


