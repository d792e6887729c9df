"""Connected and strongly connected components, triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale.durable import release, stored
from ..scale.skew import lookup_join
from .graph import Adjacency, both_ways, reversed_edges


def _spread_min(state: DataFrame, along: Adjacency, first: str = "true") -> DataFrame:
    """Repeat ``value = min(own, values of in-neighbours)`` until nothing changes. Only vertices whose
    value fell in the round before send it, as the others' neighbours have it; at first those where
    ``first`` holds, which has to be all that can lower another's."""
    state = held = stored(state.select("id", "value"), "state")
    news = state.where(first)
    while True:
        got = along.send(news, "value").selectExpr("dst AS id", "value",
                                                   "CAST(NULL AS BIGINT) AS before")
        best = state.selectExpr("id", "value", "value AS before").union(got).groupBy("id") \
            .agg(F.expr("min(value) AS value"), F.expr("max(before) AS before")) \
            .filter("before IS NOT NULL")
        both = stored(best, "state")
        fell = both.filter("value < before")
        changed = not fell.isEmpty()
        release(held)
        held, state, news = both, both.select("id", "value"), fell.select("id", "value")
        if not changed:
            return state


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(src, dst))")).first())


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with ``component``, the smallest vertex id it is connected to.

    Alternating stars: every vertex first hands its larger neighbours on to the smallest vertex next
    to it, then its smaller ones. The edges end as one star per component; the number of rounds
    grows with the logarithm of the component's size, not with its diameter. A round works on
    written tables, whose sizes the optimizer knows, and its joins are on a vertex with its one
    smallest neighbour, so that a hub's edges can be split over tasks."""
    links = stored(edges.where("src <> dst").selectExpr(
        "greatest(src, dst) AS src", "least(src, dst) AS dst").distinct(), "links")
    mark = _mark(links)
    while True:
        both = links.union(links.selectExpr("dst AS src", "src AS dst"))
        least = both.groupBy("src").agg(F.min("dst").alias("m"))
        large = stored(both.where("dst > src").join(least, "src").selectExpr(
            "dst AS src", "least(src, m) AS dst").distinct(), "large_star")
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src")
        old, links = links, stored(small.selectExpr("dst AS src", "m AS dst").where("src <> dst")
                       .union(least.selectExpr("src", "m AS dst")).distinct(), "small_star")
        release(large)
        release(old)
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return vertices.join(links.selectExpr("src AS id", "dst AS component"), "id", "left") \
        .withColumn("component", F.coalesce("component", "id"))


def _ends(chain: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(id, up, down, least, round) of the vertices ``chain``, which have one edge in and one out: the
    first vertices against and along the edges that are not in ``chain``. Pointers double their reach,
    so the rounds grow with the logarithm of the longest chain. On a cycle of such vertices they never
    leave it (``round``); ``most`` is the number of vertices, after whose logarithm they are all round,
    and ``least`` is the smallest id on it."""
    up = edges.select(F.col("dst").alias("id"), F.col("src").alias("up"))
    down = edges.select(F.col("src").alias("id"), F.col("dst").alias("down"))
    state = stored(chain.join(up, "id").join(down, "id").select("*", F.col("id").alias("least"),
                                                                F.lit(True).alias("round")), "chain")
    # One more round shows where the last step led.
    for _ in range(most.bit_length() + 1):
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        below = state.select(F.col("id").alias("down"), F.col("down").alias("_down"),
                             F.col("least").alias("_least"))
        before, state = state, stored(state.drop("round").join(above, "up", "left")
                                      .join(below, "down", "left").select(
            "id", F.coalesce("_up", "up").alias("up"), F.coalesce("_down", "down").alias("down"),
            F.least("least", "_least").alias("least"),
            (F.col("_up").isNotNull() | F.col("_down").isNotNull()).alias("round")), "chain")
        release(before)
        if state.filter("round").isEmpty():
            break
    return state


def _degrees(open_: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ins, outs): edges in and out of each vertex and each end of an edge."""
    return stored(open_.selectExpr("id", "0 AS ins", "0 AS outs").unionByName(
        edges.selectExpr("src AS id", "0 AS ins", "1 AS outs")).unionByName(
        edges.selectExpr("dst AS id", "1 AS ins", "0 AS outs")).groupBy("id").agg(
        F.sum("ins").alias("ins"), F.sum("outs").alias("outs")), "degrees")


def _coloured(open_: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, colour, value): every vertex with the smallest id that reaches it, and value 0 where it
    reaches that vertex in turn; and the edges within a colour."""
    colour = _spread_min(open_.select("id", F.col("id").alias("value")), Adjacency(edges, written=True)) \
        .select("id", F.col("value").alias("colour"))
    inner = stored(_within(edges, colour), "graph")
    # 0 marks "reaches the vertex the colour is named after".
    start = colour.select("id", F.when(F.col("id") == F.col("colour"), F.lit(0))
                          .otherwise(F.lit(1)).cast("long").alias("value"))
    reach = _spread_min(start, Adjacency(reversed_edges(inner), written=True), "value = 0")
    return stored(colour.join(reach, "id"), "graph"), inner


def strongly_connected_components(vertices: DataFrame, edges: DataFrame,
                                  max_iter: int | None = None) -> DataFrame:
    """Vertices with ``component``, the smallest id of the vertices that reach it and that it
    reaches.

    First the graph is made small and short: vertices with one edge in and one out are taken out, and
    the chains of them become edges between their ends; vertices without edges in or out are components
    by themselves. A chain belongs to the component of its ends if they are in the same one, and else
    its vertices stand alone. This goes on while it takes out a tenth of the vertices. Then each
    vertex is coloured with the smallest id that reaches it; one that in turn reaches its colour's name
    belongs to that component and is done, and edges between colours are dropped. The rounds of a
    colouring grow with the diameter of what is left without its chains. If ``max_iter`` colourings
    leave vertices open, it raises."""
    open_ = stored(vertices.select("id"), "graph")
    edges = stored(edges.select("src", "dst").filter("src <> dst").dropDuplicates(), "graph")
    parts, chains = [], []
    left, colourings = open_.count(), 0
    while left:
        before = left
        degree = _degrees(open_, edges)
        chain = degree.where("ins = 1 AND outs = 1").select("id")
        if not chain.isEmpty():
            ends = _ends(chain, edges, left)
            parts.append(ends.where("round").select("id", F.col("least").alias("component")))
            led = ends.where("NOT round").select("id", "up", "down")
            chains.append(led)
            kept = edges
            for end in ("src", "dst"):
                kept = kept.join(ends.select(F.col("id").alias(end)), end, "left_anti")
            edges = stored(kept.select("src", "dst").union(led.select("up", "down"))
                           .where("src <> dst").distinct(), "graph")
            open_ = stored(open_.join(ends.select("id"), "id", "left_anti"), "graph")
            degree = _degrees(open_, edges)
        core = stored(open_.join(degree.where("ins > 0 AND outs > 0"), "id", "left_semi"), "core")
        if not degree.join(core, "id", "left_anti").isEmpty():
            parts.append(open_.join(core, "id", "left_anti").select("id", F.col("id").alias("component")))
            for end in ("src", "dst"):
                edges = edges.join(core.select(F.col("id").alias(end)), end, "left_semi")
            edges = stored(edges.select("src", "dst"), "graph")
        open_ = core
        left = open_.count()
        if before - left >= before / 10 or not left:
            continue
        if colourings == max_iter:
            raise RuntimeError(f"vertices are open after {max_iter} rounds")
        colourings += 1
        marked, inner = _coloured(open_, edges)
        parts.append(marked.filter("value = 0").select("id", F.col("colour").alias("component")))
        rest = marked.filter("value = 1")
        open_ = rest.select("id")
        edges = stored(_within(inner, rest.select("id", "colour")), "graph")
        left = open_.count()
    found = vertices.select("id", F.col("id").alias("component")).limit(0)
    for part in parts:
        found = found.unionByName(part)
    # The ends of a chain are known once all that was taken out later is.
    for led in reversed(chains):
        found = stored(found, "found")
        up = found.select(F.col("id").alias("up"), F.col("component").alias("_up"))
        down = found.select(F.col("id").alias("down"), F.col("component").alias("_down"))
        found = found.union(led.join(up, "up").join(down, "down").select("id", F.when(
            F.col("_up") == F.col("_down"), F.col("_up")).otherwise(F.col("id"))))
    # A chain may hold a smaller id than the component was named by.
    found = stored(found, "found")
    named = found.groupBy("component").agg(F.min("id").alias("least"))
    return vertices.join(found.join(named, "component").select("id", F.col("least").alias("component")),
                         "id")


def _within(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Edges whose ends have the same colour. Reads ``colour`` from a lineage cut."""
    for end in ("src", "dst"):
        named = colour.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))
        edges = lookup_join(edges, named, [end], "inner")
    return edges.filter("src_colour = dst_colour").select("src", "dst")


def triangle_count(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with ``count``, the number of triangles through each, directions ignored.

    Edges are turned from the end with fewer neighbours to the one with more. Then no vertex
    has more than sqrt(2 E) outgoing edges, so a neighbour list is small whatever the hubs, and
    each triangle is found once, as a common element of the lists of an edge's ends."""
    plain = stored(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
                .filter("a <> b").dropDuplicates(), "graph")
    degree = stored(both_ways(plain.select(F.col("a").alias("src"), F.col("b").alias("dst")))
                 .groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "graph")
    for end in ("a", "b"):
        named = degree.select(F.col("id").alias(end), F.col("d").alias(f"d{end}"))
        plain = lookup_join(plain, named, [end], "inner")
    forward = F.struct("da", "a") < F.struct("db", "b")
    turned = stored(plain.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("low"),
                              F.when(forward, F.col("b")).otherwise(F.col("a")).alias("high")), "graph")
    lists = turned.groupBy("low").agg(F.collect_list("high").alias("near"))
    withlow = turned.join(lists, "low")
    high = lists.select(F.col("low").alias("high"), F.col("near").alias("far"))
    joined = lookup_join(withlow, high, ["high"], "inner")
    closed = joined.select("low", "high", F.array_intersect("near", "far").alias("third")) \
        .filter(F.size("third") > 0)
    n = F.size("third").cast("long")
    hits = closed.select(F.explode(F.concat(
        F.array(F.struct(F.col("low").alias("id"), n.alias("n")),
                F.struct(F.col("high").alias("id"), n.alias("n"))),
        F.transform("third", lambda t: F.struct(t.alias("id"), F.lit(1).cast("long").alias("n")))
    )).alias("h")).select("h.*")
    found = hits.groupBy("id").agg(F.sum("n").alias("count"))
    return vertices.join(found, "id", "left").withColumn("count",
                                                         F.coalesce("count", F.lit(0)))
