"""The trie of conversation prefixes, with count-min screening of prefix digests.

1. Turns are numbered within their conversation and reduced to two 64-bit hashes of role and text.
   The digest of a prefix is the exclusive-or of its turns' hashes, each with its place mixed in, so
   that digests run along a conversation of any length by partitions (``scans``); texts are read
   once and never shuffled. Equal digests (128 bits) are taken for equal prefixes.
2. A count-min sketch counts the digests: ``ROWS`` rows of cells, as many as make it eight times the
   prefixes, ``MOST_CELLS`` a row at most. An estimate is never too low, so an estimate of one proves
   that a prefix has one conversation only. Whether a cell counts one or more is all that is asked,
   so that is all that is kept: a bit a cell, ``ROWS * MOST_CELLS / 8`` bytes (64 MiB) at most for
   every task. Beyond that size fewer prefixes are proven, and results are the same.
3. Prefixes behind a proven one are the tail of one conversation; their nodes are made where they
   are. Only the rest is shuffled and grouped exactly.
4. Nodes are summed up without walking the trie. A node stands for the smallest of its members, its
   head. Words saved in a subtree are all words from there on of all members, less the words of the
   nodes below, each counted at its head; a head has its nodes from one depth on, so one number for
   each conversation is enough. Leaves are counted at their heads likewise.
5. Ids that end at a node are joined in order to strings by range partitions, and the strings of a
   node are hashed one after another: one task holds one piece of them at a time.

Turns are in order of ``turn``, null first, and turns of one number in order of their hashes; null
role or text is empty. Rows without a ``conv_id`` belong to no conversation and are left out.
Repeated rows are turns of their own. No rows give no nodes, not even a root. Words are runs of
anything but space, tab and line ends. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..scale.durable import stored
from .mixing import word_count
from .scans import dealt, running

ROWS, MOST_CELLS, LEAST_CELLS = 2, 1 << 28, 1 << 16
_KEY = ["depth", "x", "y"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, a, b, words): each turn with its place from 1, two hashes and its words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        word_count(text).alias("words"))
    order = ["turn", "a", "b"]
    return stored(running(dealt(rows, ["conv_id"], order), ["conv_id"], order,
                          {"at": ("sum", F.lit(1))})
                  .select("conv_id", "at", "a", "b", "words"), "turns")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


def regrown(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin like the first of their family: conversation c
    has the first h turns of c - c % ``family``, h being the crc32 of its decimal id modulo ``most``,
    and then its own turns behind its first h."""
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("at") < most)) \
        .groupBy(F.col("conv_id").alias("base")) \
        .agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "words"))).alias("first"))
    ids = lengths(turns).select("conv_id", "length", F.expr(f"conv_id - conv_id % {family}").alias("base"),
                                (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
                                .cast("int").alias("h"))
    grown = ids.join(heads, "base", "left").select(
        "conv_id", "h", F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), F.col("h")))
        .alias("first"), F.greatest(F.col("length") - F.col("h"), F.lit(0)).alias("own")) \
        .withColumn("n_first", F.coalesce(F.size("first"), F.lit(0)))
    grown = stored(grown, "grown")
    own = turns.join(grown.select("conv_id", "h", "n_first"), "conv_id").where("at > h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("n_first")).alias("at"), "a", "b", "words")
    lent = grown.select("conv_id", F.inline("first")).select(*own.columns)
    return own.union(lent), grown.select("conv_id", (F.col("own") + F.col("n_first")).alias("length"))


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, px, py, left, length): each prefix of a turn or more with its digest,
    its parent's, and the words of the conversation from its last turn on."""
    totals = stored(turns.groupBy("conv_id").agg(F.sum("words").alias("total"))
                    .join(lengths, "conv_id"), "totals")
    placed = turns.join(totals, "conv_id").select(
        "conv_id", "at", F.xxhash64("at", "a").alias("a"), F.xxhash64("at", "b").alias("b"), "words",
        "total", "length")
    run = running(dealt(placed, ["conv_id"], ["at"]), ["conv_id"], ["at"], {
        "x": ("xor", F.col("a")), "y": ("xor", F.col("b")), "upto": ("sum", F.col("words"))})
    return stored(run.select(
        "conv_id", F.col("at").alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("px"),
        F.col("y").bitwiseXOR(F.col("b")).alias("py"),
        (F.col("total") - F.col("upto") + F.col("words")).alias("left"), "length"), "prefixes")


def _cells(x: Column, y: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(F.lit(row), x, y), 64 - bits) for row in range(ROWS)]


def maybe_shared(found: DataFrame, cells: int | None = None):
    """A function of the columns of a digest that is false only if the digest is proven to be in
    ``found`` once."""
    n = found.count()
    cells = cells or min(MOST_CELLS, max(LEAST_CELLS, 1 << (8 * n).bit_length()))
    bits = cells.bit_length() - 1
    counted = found.select(F.posexplode(F.array(*_cells(F.col("x"), F.col("y"), bits)))
                           .alias("row", "cell")).groupBy("row", "cell") \
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("cell", F.col("cell") + 1)
    # Pieces of 4 KiB: ROWS * cells / 32768 of them at most, whatever the table.
    pieces = counted.groupBy("row", F.bitmap_bucket_number("cell").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).toPandas()
    size = max(1, cells >> 15) * 4096
    sketch = np.zeros((ROWS, size), np.uint8)
    for row, piece, held in zip(pieces["row"], pieces["piece"], pieces["bits"]):
        sketch[row, (piece - 1) * 4096:piece * 4096] = np.frombuffer(held, np.uint8)
    shared = found.sparkSession.sparkContext.broadcast(sketch)

    @F.pandas_udf(BooleanType())
    def all_set(*columns: pd.Series) -> pd.Series:
        out = np.ones(len(columns[0]), bool)
        for bits_of, cell in zip(shared.value, columns):
            at = cell.to_numpy(np.int64)
            out &= (bits_of[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return pd.Series(out)

    return lambda x, y: all_set(*_cells(x, y, bits))


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ids of nodes as strings, one for each node and frame."""
    for frame in frames:
        if len(frame):
            yield frame.groupby(_KEY, sort=False)["conv_id"].agg(
                [("first", "first"), ("ids", lambda s: ",".join(map(str, s)))]).reset_index()


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of the strings of each node, which come in order."""
    key, digest = None, None
    for frame in frames:
        out = []
        for *now, ids in frame[[*_KEY, "ids"]].itertuples(index=False):
            if now == key:
                digest.update(b",")
            else:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256()
            digest.update(ids.encode())
        yield pd.DataFrame(out, columns=[*_KEY, "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*_KEY, "ends_sha256"])


def _ends(prefix_rows: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of the nodes at which conversations end."""
    key = "depth long, x long, y long"
    ends = prefix_rows.where("depth = length").select(*_KEY, "conv_id")
    pieces = ends.repartitionByRange("x", "y", "depth", "conv_id") \
        .sortWithinPartitions(*_KEY, "conv_id") \
        .mapInPandas(_joined, f"{key}, first long, ids string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first") \
        .mapInPandas(_hashed, f"{key}, ends_sha256 string")


def nodes(turns: DataFrame, lengths: DataFrame, cells: int | None = None) -> DataFrame:
    """The nodes of the trie of ``turns`` (as ``numbered`` gives them) and ``lengths`` (conv_id,
    length; a conversation of length 0 has no turns): conv_id, the smallest member; depth;
    parent_conv_id; n_convs; n_children; n_leaves; saved_tokens; ends_sha256."""
    lengths = stored(lengths, "lengths")
    found = prefixes(turns, lengths)
    may = maybe_shared(found, cells)
    open_ = (F.col("depth") == 1) | may(F.col("px"), F.col("py"))
    columns = ["conv_id", *_KEY, "px", "py", "left", "length"]
    firsts = found.where("depth = 1").select("conv_id", "left")
    none = F.lit(None).cast("long")
    roots = lengths.join(firsts, "conv_id", "left").select(
        "conv_id", *[F.lit(0).cast("long").alias(c) for c in _KEY], none.alias("px"),
        none.alias("py"), F.coalesce("left", F.lit(0)).alias("left"), "length")
    exact = stored(found.where(open_).select(*columns).union(roots.select(*columns)), "open")

    grouped = stored(exact.groupBy(*_KEY, "px", "py").agg(
        F.min(F.struct("conv_id", "left")).alias("head"), F.count(F.lit(1)).alias("n_convs"),
        F.max("length").alias("longest")), "grouped")
    alone = (F.col("n_convs") == 1)
    heads = stored(grouped.groupBy("head.conv_id").agg(
        F.min(F.struct("depth", F.col("head.left").alias("left"))).alias("from"),
        F.max((alone | (F.col("longest") == F.col("depth"))).cast("long")).alias("leaf")), "heads")
    once = F.when(F.col("depth") >= F.col("from.depth"), F.col("left")).otherwise(F.col("from.left"))
    sums = exact.select(*_KEY, "left", "conv_id").join(heads, "conv_id", "left").groupBy(*_KEY).agg(
        F.sum(F.col("left") - F.coalesce(once, F.lit(0))).alias("saved_tokens"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
    children = grouped.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")) \
        .agg(F.count(F.lit(1)).alias("n_below"))
    above = grouped.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"),
                           F.col("y").alias("py"), F.col("head.conv_id").alias("parent"))
    # A parent that was not opened is proven to have this conversation alone.
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "head.conv_id"))
    named = grouped.join(above, ["depth", "px", "py"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    shared = named.join(sums, _KEY).join(children, _KEY, "left").join(_ends(exact), _KEY, "left") \
        .select(F.col("head.conv_id").alias("conv_id"), "depth", parent.alias("parent_conv_id"),
                "n_convs", F.when(alone, (F.col("longest") > F.col("depth")).cast("long"))
                .otherwise(F.coalesce("n_below", F.lit(0))).alias("n_children"), "n_leaves",
                "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    ended = F.col("depth") == F.col("length")
    tails = found.where(~open_).select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).alias("n_convs"),
        (~ended).cast("long").alias("n_children"), F.lit(1).alias("n_leaves"),
        F.lit(0).alias("saved_tokens"),
        F.when(ended, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
        .otherwise(F.lit(empty)).alias("ends_sha256"))
    longs = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
             "saved_tokens"]
    return shared.unionByName(tails).select(*[F.col(c).cast("long").alias(c) for c in longs],
                                            "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations as they are."""
    turns = numbered(conversations)
    return nodes(turns, lengths(turns))
