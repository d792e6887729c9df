"""Item-to-item transition graph: vertices, edges, degrees, re-indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale.durable import bucketed, buckets, stored
from ..scale.skew import lookup_join
from .journeys import packing, transitions

SLOTS = 1 << 16


def graph_vertices(tags: DataFrame, objects: DataFrame, departments: DataFrame) -> DataFrame:
    """One row per distinct tagged object: catalogue metadata, or empty text and
    ``meta_store`` 0."""
    ids = tags.filter(F.col("refers_to_object_id").isNotNull()) \
        .select(F.col("refers_to_object_id").cast("long").alias("id")).distinct()
    names = departments.groupBy(F.col("id").alias("department_id")) \
        .agg(F.min("name").alias("department"))
    entries = lookup_join(objects, names, ["department_id"]).select(
        F.col("id").cast("long").alias("id"), "title", "date", "department",
        F.when(F.col("department").isNotNull(), F.col("department_id")).alias("department_id"),
        "type", "type_id", F.col("is_loan_object").cast("string").alias("loan"))
    text = [c for c in entries.columns if c != "id"]
    # An object listed twice is described by its first entry.
    first = entries.groupBy("id").agg(F.min(F.struct(*text)).alias("e")) \
        .select("id", "e.*", F.lit(1).alias("meta_store"))
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in text}
    return ids.join(first, "id", "left").withColumns(blank) \
        .withColumn("meta_store", F.coalesce("meta_store", F.lit(0)))


def all_edges(tags: DataFrame, written: bool = False) -> DataFrame:
    """Distinct consecutive pairs of journeys, self-loops included. ``written`` tags are cheap to read,
    so they are looked over first for whether their ids can be packed (``journeys.packing``)."""
    return transitions(tags, packing(tags) if written else None).dropDuplicates()


def graph_edges(edges: DataFrame, vertices: DataFrame, known: bool = False) -> DataFrame:
    """The edges whose two ends have metadata. If every end is ``known`` to be one of the vertices, edges
    are compared with the vertices without metadata only, mostly few, which need no shuffle of edges."""
    some, how = ("meta_store = 0", "left_anti") if known else ("meta_store = 1", "left_semi")
    listed = stored(vertices.filter(some).select("id"), "listed")
    for end in ("src", "dst"):
        edges = lookup_join(edges, listed.withColumnRenamed("id", end), [end], how)
    return edges.select("src", "dst")


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree")) \
        .orderBy(F.desc("in_degree"), "id")


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree")) \
        .orderBy(F.desc("out_degree"), "id")


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends per vertex; a self-loop counts twice."""
    return both_ways(edges).groupBy(F.col("src").alias("id")) \
        .agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id")


def graph_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"),
                                                               "value")
    return size(vertices, "n_vertices").unionByName(size(edges, "n_edges"))


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").unionByName(back)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def endpoints(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("src").alias("id")).distinct()


def _frequent(edges: DataFrame, most: int) -> DataFrame:
    """(src) of the sources with more than ``most`` edges. Edges are first counted in a few slots by the
    hash of their source, as a source cannot have more than its slot; only full slots are counted by source."""
    slot = F.pmod(F.hash("src"), F.lit(SLOTS))
    full = stored(edges.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > most).select("slot"), "full")  # total / most slots at most
    return edges.withColumn("slot", slot).join(F.broadcast(full), "slot", "left_semi") \
        .groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("src")


class Adjacency:
    """Edges kept for repeated passes that send a value along each edge.

    The edges are written once, in buckets by source (``durable.bucketed``): a pass brings the state
    of the vertices to them, and edges are never shuffled. A source with more edges than a bucket holds
    on average, or than ``BUSY``, would fill a bucket by itself: there are no more such sources than
    buckets, so their edges are dealt evenly and their values sent to all tasks. Fewer edges than ``SMALL`` stay as they are: one task reads them faster than many open
    their buckets. There are enough buckets that one holds about ``BUCKET`` edges at most."""

    BUSY, SMALL, BUCKET = 10_000, 1 << 20, 1 << 21

    def __init__(self, edges: DataFrame, written: bool = False):
        """``written`` edges are cheap to read, so they are only written into their buckets."""
        spark = edges.sparkSession
        edges = edges.select("src", "dst") if written else stored(edges.select("src", "dst"), "edges")
        self.total = total = edges.count()
        self._n = n = max(buckets(spark), total // self.BUCKET)
        self._busy = self._spread = None
        self._dealt = total >= self.SMALL
        if not self._dealt:
            self._edges = edges
            return
        most = max(total // n, self.BUSY)
        busy = stored(_frequent(edges, most), "busy")
        if not busy.isEmpty():  # n sources at most
            self._busy = busy
            self._spread = stored(edges.join(F.broadcast(busy), "src", "left_semi").repartition(n),
                                  "edges")
            edges = edges.join(F.broadcast(busy), "src", "left_anti")
        self._edges = bucketed(edges.repartition(n, "src"), "src", "edges", n)

    def counted(self) -> DataFrame:
        """(src, dst, n): how often each edge is there. Sources that aren't busy are counted where they lie."""
        def times(edges: DataFrame) -> DataFrame:
            return edges.groupBy("src", "dst").agg(F.expr("count(1) AS n"))
        own = times(self._edges)
        return own if self._busy is None else own.union(times(self._spread))

    @property
    def gathers(self) -> bool:
        """Whether ``by_target`` brings the rows of a target together."""
        return self._busy is None

    def by_target(self, sent: DataFrame) -> DataFrame:
        """``sent`` with the rows of a target in one task, if no source is busy. That is for edges that go
        both ways, where a target has as many edges as it has as a source."""
        if self._busy is not None:
            return sent
        return sent.repartition(self._n, "dst") if self._dealt else sent.repartition("dst")

    def send(self, state: DataFrame, value: str, name: str = "value") -> DataFrame:
        """(dst, value) for each edge; ``value`` is an SQL expression over the source's row."""
        state = state.selectExpr("id AS src", f"{value} AS {name}")
        # A bucket's share of the state is hashed, so that its edges need no sorting in every pass.
        held = state.hint("shuffle_hash") if self._dealt else state
        sent = self._edges.join(held, "src").select("dst", name)
        if self._busy is None:
            return sent
        few = state.join(F.broadcast(self._busy), "src", "left_semi")
        return sent.union(self._spread.join(F.broadcast(few), "src").select("dst", name))


def vertex_reindex(edges: DataFrame) -> DataFrame:
    """(id, index): the endpoints numbered 0..n-1 in id order.

    Range partitions are fixed by a lineage cut; each is numbered by itself and shifted by the
    sizes of those before it (one small row per partition)."""
    placed = stored(endpoints(edges).repartitionByRange("id")
                    .withColumn("part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part").orderBy("id")
    return placed.withColumn("nth", F.row_number().over(inside) - 1) \
        .join(shifts, "part").select("id", (F.col("shift") + F.col("nth")).alias("index"))


def reindexed_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges between vertex numbers."""
    index = stored(index, "index")
    for end in ("src", "dst"):
        named = index.select(F.col("id").alias(end), F.col("index").alias(f"{end}_index"))
        edges = lookup_join(edges, named, [end], "inner")
    return edges.select(F.col("src_index").alias("src"), F.col("dst_index").alias("dst"))
