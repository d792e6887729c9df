"""Label propagation and community profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale.durable import release, stored
from ..scale.skew import lookup_join
from .graph import Adjacency, both_ways
from .summaries import top_per_group

PACKED = (1 << 31) - 1  # the largest label, and number of edges, that fit into one long together

def tallied(dst: np.ndarray, label: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dst, label, n) of messages by target and label; unless ``whole``, only the label of each target
    with the most votes, then the smallest."""
    if dst.size and min(dst.min(), label.min()) >= 0 and max(dst.max(), label.max()) <= PACKED:
        both = np.sort(dst << 31 | label)  # one number sorts several times as fast as two
        dst, label = both >> 31, both & PACKED
    else:
        order = np.lexsort((label, dst))
        dst, label = dst[order], label[order]

    def starts(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(columns[0].size, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return np.flatnonzero(new)
    at = starts(dst, label)
    n, dst, label = np.diff(at, append=dst.size), dst[at], label[at]
    if not whole and n.size:
        own = starts(dst)
        most = np.repeat(np.maximum.reduceat(n, own), np.diff(own, append=dst.size))
        led = np.flatnonzero(n == most)
        led = led[starts(dst[led])]
        dst, label, n = dst[led], label[led], n[led]
    return dst, label, n


def _tally(sent: DataFrame, whole: bool) -> DataFrame:
    """``tallied`` for each partition of ``sent``, which has the messages of a target in one of them.
    A partition is about as large as a bucket of edges."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        columns = tallied(*(np.concatenate(c) for c in zip(*parts)), whole)
        table = pa.table([pa.array(c) for c in columns], names=["dst", "label", "n"])
        yield from table.to_batches(1 << 16)
    return sent.mapInArrow(run, "dst long, label long, n long")


def _votes(along: Adjacency, state: DataFrame, proper: bool, whole: bool = True) -> DataFrame:
    """(dst, label, n): how many neighbours of a vertex have a label. Unless ``whole``, labels of a vertex
    that do not win may be left out."""
    sent = along.send(state, "label", "label")
    if proper and along.gathers and [t for _, t in sent.dtypes] == ["bigint", "bigint"]:
        return _tally(along.by_target(sent), whole)
    return (along.by_target(sent) if proper else sent).groupBy("dst", "label").agg(F.expr("count(1) AS n"))


def _changed_votes(counts: DataFrame, along: Adjacency, state: DataFrame) -> DataFrame:
    """The votes ``counts`` of the last round after the labels that it changed: neighbours lose a vote for
    the label before and gain one for the new label."""
    moves = along.send(state.where("label <> before"), "array(struct(label, 1L AS n), "
                       "struct(before AS label, -1L AS n))", "moves").selectExpr("dst", "inline(moves)")
    return counts.union(moves).groupBy("dst", "label").agg(F.expr("sum(n) AS n")).where("n > 0")


def _elected(state: DataFrame, votes: DataFrame, packs: bool) -> DataFrame:
    """(id, label, before, earlier, held): the label with the most votes, then the smallest. The last two
    labels ride along with no votes. Where votes and label fit into one long (``packs``), the largest is
    the one wanted, and nothing is sorted for it."""
    best, label = ("max(struct(n, -label AS low))", "-best.low") if not packs else (
        f"max(CASE WHEN label BETWEEN 0 AND {PACKED} THEN shiftleft(n, 31) + ({PACKED} - label) END)",
        f"{PACKED} - (best & {PACKED})")
    nothing = "CAST(NULL AS BIGINT)"
    held = state.selectExpr("id AS dst", "id AS label", "0L AS n", "label AS before", "before AS earlier",
                            "1L AS held")
    return stored(held.union(votes.selectExpr("dst", "label", "n", nothing, nothing, "0L"))
                  .groupBy("dst")
                  .agg(F.expr(f"{best} AS best"), F.expr("max(before) AS before"),
                       F.expr("max(earlier) AS earlier"), F.expr("sum(held) AS held"))
                  .selectExpr("dst AS id", f"{label} AS label", "before", "earlier", "held"), "labels")


def label_propagation(vertices: DataFrame, edges: DataFrame, max_iter: int = 50) -> DataFrame:
    """Vertices with a community ``label``: each round every vertex takes the most frequent
    label of its neighbours (edges count both ways), ties to the smallest. Ends early once the
    labels of a round are those of the round before or of the one before that, as it is then known
    what later rounds give.

    The labels of the first round are the ids, so that it counts edges where they lie. Once fewer than
    half of the vertices change, the votes are kept, and while fewer than a quarter do, only changes are
    sent. Both need every end of an edge to be a vertex, once; with others a round sends all labels.
    Messages that lie by target are counted with numpy (``tallied``), others by Spark."""
    ids = stored(vertices.select("id"), "ids")
    along = Adjacency(both_ways(stored(edges.select("src", "dst"), "edges")), written=True)
    state = ids.selectExpr("id", "id AS label", "CAST(NULL AS BIGINT) AS before")
    low, high, size = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    packs = size > 0 and 0 <= low and high <= PACKED and along.total <= PACKED
    proper, counts, moved = True, None, size
    for i in range(1, max_iter + 1):
        last_state, last_counts, counts = state, counts, None
        if i == 1:
            votes = along.counted().selectExpr("src AS dst", "dst AS label", "n")
        elif last_counts is not None and moved * 4 < size:
            votes = _changed_votes(last_counts, along, state)
        else:
            votes = _votes(along, state, proper, moved * 2 < size)
        if i > 1 and proper and moved * 2 < size:
            votes = counts = stored(votes, "votes")
        state = _elected(last_state, votes, packs)
        if i == 1 and not state.agg(F.expr("bool_and(held = 1 AND id IS NOT NULL)")).first()[0]:
            release(state)
            proper = packs = False
            state = _elected(last_state, _votes(along, last_state, proper), packs)
        release(last_state)
        if last_counts is not None:
            release(last_counts)
        moved, new = state.agg(F.expr("count_if(label <> before)"),
                               F.expr("bool_or(earlier IS NULL OR label <> earlier)")).first()
        if not moved:
            break
        if not new:
            # The two states take turns: the last round gives this one or the one before.
            last = "label" if (max_iter - i) % 2 == 0 else "before"
            state = state.selectExpr("id", f"{last} AS label")
            break
    return vertices.join(state.select("id", "label"), "id")


def majority_labels(communities: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` labels with most vertices, ties to the smallest label."""
    return communities.groupBy("label").agg(F.count("id").alias("size")) \
        .orderBy(F.desc("size"), "label").limit(k)


def majority_clusters(communities: DataFrame, k: int = 5) -> DataFrame:
    """Vertices of the ``k`` largest communities (``k`` labels are broadcast)."""
    chosen = majority_labels(communities, k).select("label")
    return communities.join(F.broadcast(chosen), "label", "left_semi") \
        .select("id", "department", "type", "loan", "label")


def _label_counts(counted: DataFrame, clusters: DataFrame, column: str) -> DataFrame:
    """(label, column, count) from rows (id, column, n) that hold one row per id and value."""
    return counted.join(clusters.select("id", "label"), "id") \
        .filter(F.col(column).isNotNull()) \
        .groupBy("label", column).agg(F.sum("n").alias("count"))


def _tags_by(tags: DataFrame, *columns: str) -> DataFrame:
    """Tags counted per object before any join: a popular object becomes one row."""
    return tags.groupBy(F.col("refers_to_object_id").alias("id"), *columns) \
        .agg(F.count(F.lit(1)).alias("n"))


def cluster_flag_counts(tags: DataFrame, clusters: DataFrame, flag: str) -> DataFrame:
    """Tags of each community by a tag flag (``during_exhibition``, ``tagged_after_close``)."""
    return _label_counts(_tags_by(tags, flag), clusters, flag)


def cluster_attribute_counts(tags: DataFrame, clusters: DataFrame, attribute: str,
                             top: int | None = None) -> DataFrame:
    """Tags of each community by a vertex attribute (``loan``, ``department``, ``type``)."""
    counts = _tags_by(tags).join(clusters.select("id", "label", attribute), "id") \
        .filter(F.col(attribute).isNotNull()) \
        .groupBy("label", attribute).agg(F.sum("n").alias("count"))
    return counts if top is None else top_per_group(counts, "label", attribute, "count", top)


def cluster_room_counts(loctypes: DataFrame, clusters: DataFrame, top: int = 5) -> DataFrame:
    """Location rows of each community by room, the ``top`` rooms per label. Rows of other objects go
    before anything is counted."""
    members = clusters.select("id").distinct()
    places = loctypes.join(members, "id", "left_semi").groupBy("id", "room_name").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(_label_counts(places, clusters, "room_name"), "label", "room_name",
                         "count", top)


def cluster_profiles(tags: DataFrame, loctypes: DataFrame,
                     clusters: DataFrame) -> dict[str, DataFrame]:
    """All six two-level counts."""
    return {
        "exhibitions": cluster_flag_counts(tags, clusters, "during_exhibition"),
        "after_close": cluster_flag_counts(tags, clusters, "tagged_after_close"),
        "loan": cluster_attribute_counts(tags, clusters, "loan"),
        "departments": cluster_attribute_counts(tags, clusters, "department"),
        "types": cluster_attribute_counts(tags, clusters, "type", 5),
        "rooms": cluster_room_counts(loctypes, clusters),
    }


def cluster_type_correlation(clusters: DataFrame) -> DataFrame:
    """(label, a, b, corr): Pearson correlation within each community of the indicator columns
    of department and type, for the levels the community has; null for a level all its
    vertices share.

    Indicators are known by counts: with n vertices, a of one level, b of the other and ab of
    both, the correlation is (n ab - a b) / sqrt(a (n - a) b (n - b)). The vertices are counted
    once per (label, department, type); the matrix is made of level counts, whose number is
    bounded by the catalogue's vocabulary."""
    cells = clusters.groupBy("label", "department", "type") \
        .agg(F.count(F.lit(1)).alias("n"))
    dept = F.concat(F.lit("dept_"), F.col("department"))
    kind = F.concat(F.lit("type_"), F.col("type"))
    sizes = cells.groupBy("label").agg(F.sum("n").alias("total"))
    levels = cells.select("label", F.explode(F.array(dept, kind)).alias("level"), "n") \
        .filter(F.col("level").isNotNull()) \
        .groupBy("label", "level").agg(F.sum("n").alias("n"))
    sides = cells.select("label", F.array(dept, kind).alias("has"), "n")
    together = sides.select("label", F.explode("has").alias("a"), "has", "n") \
        .select("label", "a", F.explode("has").alias("b"), "n") \
        .groupBy("label", "a", "b").agg(F.sum("n").alias("ab"))
    one = levels.select("label", F.col("level").alias("a"), F.col("n").alias("na"))
    two = levels.select("label", F.col("level").alias("b"), F.col("n").alias("nb"))
    matrix = one.join(two, "label").join(sizes, "label") \
        .join(together, ["label", "a", "b"], "left")
    n, na, nb = (F.col(c).cast("double") for c in ("total", "na", "nb"))
    ab = F.coalesce("ab", F.lit(0)).cast("double")
    spread = na * (n - na) * nb * (n - nb)
    return matrix.select("label", "a", "b",
                         F.when(spread > 0, (n * ab - na * nb) / F.sqrt(spread)).alias("corr"))


def community_subgraph(edges: DataFrame, clusters: DataFrame, most: int = 15) -> DataFrame:
    """Edges with an end in the communities, of those sources that have at most ``most`` such
    edges."""
    member = stored(clusters.select("id", F.lit(True).alias("member")), "members")
    marked = edges.select("src", "dst").dropDuplicates()
    for end in ("src", "dst"):
        named = member.select(F.col("id").alias(end), F.col("member").alias(f"{end}_member"))
        marked = lookup_join(marked, named, [end])
    subset = stored(marked.filter(F.col("src_member") | F.col("dst_member"))
                    .select("src", "dst"), "subset")
    few = subset.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    return lookup_join(subset, few.select("src"), ["src"], "left_semi")


def community_vertices(clusters: DataFrame) -> DataFrame:
    return clusters.select("id", "type", "label")

