"""Similarity self-join of texts by n-gram Jaccard, by chosen paths.

Texts become sets of hashed five-word shingles. In each run a set picks each of its shingles with
probability ``RATE / (THRESHOLD * size)``, by a hash that all sets share, and goes to the bucket of
each shingle picked; sets as similar as ``THRESHOLD`` have ``RATE`` picks in common on average. A
bucket of more than ``SMALL`` sets is split again by further picks, ``LEVELS`` times at most, unless
half of its sets have the same smallest hash: such sets are nearly equal and stay together. A pair
is missed by a run with probability exp(-RATE) at most in a bucket that stays whole, and the runs
needed for the target recall follow from the worst case, a pair that is split at every level.

Small buckets are compared by brute force. What stays large is compared by brute force as well, cut
into blocks that tasks share.
Every pair is counted once: in the first of the buckets that it has in common.

Sets that are equal are one set from the start, so copies cost nothing; groups of sets in one bucket
are linked through union within the task, and the groups of all tasks by connected components. No
list of pairs is ever made.

Null and empty texts, and texts without a word, are in a class of their own each, without links. A
text of fewer than five words has one shingle. Repeated rows are copies. Ids must not be null to be
in a class with others: rows with a null id get class and links of their text.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..operators.components import connected_components
from ..scale.durable import stored
from .stream import map_groups
from .text import mix, shingles

THRESHOLD, GRAM = 0.8, 5
RATE, LEVELS, SMALL = 2.0, 3, 64
RECALL = 0.99
#: Sets, and hashes in them, that one task compares with as many others at a time: 4 MiB.
BLOCK, BLOCK_HASHES = 1024, 1 << 19


def runs_needed(recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold is found with this probability, even if it is split
    at every level."""
    each = (1 - math.exp(-RATE)) ** LEVELS
    return math.ceil(math.log(1 - recall) / math.log(1 - each))


def picks(s: np.ndarray, run: int, level: int) -> np.ndarray:
    h = mix(s + np.uint64((run * LEVELS + level + 1) * 0xA0761D6478BD642F % 2 ** 64))
    return s[(h >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 * len(s) * THRESHOLD < RATE]


_SETS = StructType([
    StructField("a", LongType()), StructField("b", LongType()), StructField("n", LongType()),
    StructField("least", LongType()), StructField("picks", ArrayType(ArrayType(ArrayType(LongType()))))])
_PACKED = StructType([*_SETS.fields[:3], StructField("packed", BinaryType())])


def _signature(s: np.ndarray) -> tuple[int, int, int]:
    """Two checksums and the size: equal for equal sets, and in practice for no others."""
    if not len(s):
        return 0, 0, 0
    return (int(np.bitwise_xor.reduce(mix(s)).view(np.int64)),
            int(s.sum(dtype=np.uint64).view(np.int64)), len(s))


@F.pandas_udf(_SETS)
def _sets(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        s = shingles(t, GRAM)
        least = int(mix(s).min().view(np.int64)) if len(s) else 0
        rows.append((*_signature(s), least, [[picks(s, r, k).view(np.int64).tolist()
                                       for k in range(LEVELS)]
                                      for r in range(runs_needed())] if len(s) else []))
    return pd.DataFrame(rows, columns=["a", "b", "n", "least", "picks"])


@F.pandas_udf(_PACKED)
def _packed(texts: pd.Series) -> pd.DataFrame:
    made = [shingles(t, GRAM) for t in texts]
    return pd.DataFrame([(*_signature(s), s.tobytes()) for s in made],
                        columns=["a", "b", "n", "packed"])


# A filter on a result must not make Spark call the function once more for it.
_sets = _sets.asNondeterministic()
_packed = _packed.asNondeterministic()

_ID = "xxhash64(a, b, n)"


def _buckets(sets: DataFrame) -> DataFrame:
    """(bucket, id, n): which set is in which bucket of two or more. Rows are narrow; the picks of a set
    are fetched again for the crowded buckets only."""
    path = sets.select("id", "n", F.posexplode("picks").alias("run", "levels")) \
        .select("id", "n", "run", F.explode(F.element_at("levels", 1)).alias("pick")) \
        .select("id", "n", "run", F.xxhash64("run", "pick").alias("bucket"))
    done = []
    for level in range(1, LEVELS + 1):
        path = stored(path, f"level{level}")
        sizes = stored(path.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
                       .where("size > 1"), "sizes")
        if level == LEVELS:
            done.append(path.join(sizes.select("bucket"), "bucket").select("bucket", "id", "n"))
            break
        # A table of its own, so that its size is known before the join to it is planned.
        crowded = stored(sizes.where(f"size > {SMALL}"), "crowded")
        picks = sets.select("id", "least", "picks")
        large = stored(path.join(crowded, "bucket").join(picks, "id").select(
            "id", "n", "run", "least", "bucket", "size",
            F.element_at(F.element_at("picks", F.col("run") + 1), level + 1).alias("next")), "large")
        alike = stored(large.groupBy("bucket", "size", "least").agg(F.count(F.lit(1)).alias("n"))
                       .groupBy("bucket", "size").agg(F.max("n").alias("most"))
                       .where("2 * most >= size").select("bucket"), "alike")
        whole = stored(sizes.where(f"size <= {SMALL}").select("bucket").union(alike), "whole")
        done.append(path.join(whole, "bucket").select("bucket", "id", "n"))
        path = large.join(alike, "bucket", "left_anti") \
            .select("id", "n", "run", "bucket", F.explode("next").alias("pick")) \
            .select("id", "n", "run", F.xxhash64("bucket", "pick").alias("bucket"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _places(buckets: DataFrame) -> DataFrame:
    """(leader, id, n): buckets with the same smallest id are one, as they hold much the same sets."""
    buckets = stored(buckets, "buckets")
    leaders = stored(buckets.groupBy("bucket").agg(F.min("id").alias("leader")), "leaders")
    return stored(buckets.join(leaders, "bucket").select("leader", "id", "n").distinct(), "places")


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix of whether the sets at ``left`` and at ``right`` are similar."""
    sizes = np.array([len(s) for s in sets])
    both = np.concatenate([sets[i] for i in np.concatenate((left, right))])
    values, column = np.unique(both, return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), sizes[np.concatenate((left, right))])
    common = np.zeros((len(left), len(right)))
    # Only shingles on both sides matter; a slice of them at a time bounds the matrices.
    on_left = np.zeros(len(values), bool)
    on_right = np.zeros(len(values), bool)
    is_left = row < len(left)
    on_left[column[is_left]] = True
    on_right[column[~is_left]] = True
    shared = np.flatnonzero(on_left & on_right)
    new = np.full(len(values), -1)
    new[shared] = np.arange(len(shared))
    column = new[column]
    used = column >= 0
    row, column, is_left = row[used], column[used], is_left[used]
    for low in range(0, len(shared), 4096):
        part = (column >= low) & (column < low + 4096)
        width = min(4096, len(shared) - low)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        p = part & is_left
        x[row[p], column[p] - low] = 1
        p = part & ~is_left
        y[row[p] - len(left), column[p] - low] = 1
        common += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common * 10 >= union * round(THRESHOLD * 10)


def _met_before(leaders: pd.Series, leader: int, left: np.ndarray, right: np.ndarray) \
        -> np.ndarray:
    """Matrix of whether two sets have a leader before this one in common."""
    before = [np.asarray(o, np.int64) for o in leaders]
    before = [o[o < leader] for o in before]
    names, column = np.unique(np.concatenate(before), return_inverse=True)
    row = np.repeat(np.arange(len(before)), [len(o) for o in before])
    has = np.zeros((len(before), len(names)), np.float32)
    has[row, column] = 1
    return has[left] @ has[right].T > 0


def _links(group: pd.DataFrame) -> pd.DataFrame | None:
    """Links within one pair of blocks of a leader's sets: per set its number, and the smallest id
    that it hangs together with."""
    group = group.drop_duplicates("id")  # repeated rows
    ids = group["id"].to_numpy(np.int64)
    sets = [np.frombuffer(s, np.uint64) for s in group["packed"]]
    leader, i, j = (int(group[c].iloc[0]) for c in ("leader", "i", "j"))
    block = group["block"].to_numpy(int)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return None
    # A pair belongs to the first leader that both sets have.
    similar = compare(sets, left, right) & ~_met_before(group["leaders"], leader, left, right)
    x, y = np.nonzero(similar)
    x, y = left[x], right[y]
    if i == j:
        ahead = ids[x] < ids[y]
        x, y = x[ahead], y[ahead]
    if not len(x):
        return None
    links = np.bincount(x, minlength=len(ids)) + np.bincount(y, minlength=len(ids))
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if (root == before).all():
            break
    linked = np.flatnonzero(links)
    return pd.DataFrame({"id": ids[linked], "links": links[linked], "root": ids[root[linked]]})


def _compared(places: DataFrame, firsts: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, links, root) of the sets that are similar to another, per task that found it."""
    # Written first, so that the join to a leader with very many sets can be split.
    sizes = stored(places.groupBy("leader").agg(F.count(F.lit(1)).alias("size"),
                                                F.sum("n").alias("hashes")).where("size > 1"), "sizes")
    needed = F.greatest(F.col("size") / BLOCK, F.col("hashes") / BLOCK_HASHES)
    dealt = places.join(sizes, "leader") \
        .withColumn("blocks", F.ceil(needed).cast("int")) \
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    wanted = dealt.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("leader", "block", "blocks"))).alias("to")) \
        .join(firsts.select("id", "doc_id"), "id")
    texts = documents.where("text IS NOT NULL").select("doc_id", "text")
    # The id names the rows, the signature the one among them that has the set.
    # Both sides grow with the documents, so neither is sent everywhere at any size.
    found = (texts.join(wanted.hint("merge"), "doc_id").select("id", "to", _packed("text").alias("p"))
             .select("id", "to", "p.*").where(f"{_ID} = id")
             .select("id", "packed", F.col("to.leader").alias("leaders"), F.explode("to").alias("t"))
             .select("id", "packed", "leaders", "t.*"))
    with_others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pieces = found.select("*", F.explode(with_others).alias("other")).select(
        "leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "id", "packed", "leaders")
    return map_groups(pieces, ["leader", "i", "j"], _links, "id long, links long, root long")


def similar_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies), a row per row of ``documents``: the smallest id of the
    class that similarity links, the number of other distinct sets that the document's set is
    linked to, and the number of rows with the same set."""
    rows = stored(documents.select("doc_id", _sets("text").alias("s")).select("doc_id", "s.*")
                  .withColumn("id", F.expr(f"CASE WHEN n > 0 THEN {_ID} END")), "sets")
    # Equal sets are one, under the smallest document id.
    firsts = stored(rows.where("id IS NOT NULL").groupBy("id").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"), F.min("n").alias("n"),
        F.any_value("least").alias("least"), F.any_value("picks").alias("picks")), "firsts")
    named = firsts.where("doc_id IS NOT NULL")
    sets = named.select("id", "n", "least", "picks")
    found = stored(_compared(_places(_buckets(sets)), named, documents), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    parts = connected_components(links.select("id"), found.select(
        F.col("id").alias("src"), F.col("root").alias("dst")))
    linked = stored(links.join(parts, "id").join(firsts.select("id", "doc_id"), "id"), "linked")
    classes = linked.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of_set = firsts.join(linked.join(classes, "component").select("id", "n_links", "class_id"),
                         "id", "left") \
        .select("id", "n_copies", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")
    return rows.select("doc_id", "id").join(of_set, "id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def near_distinct(documents: DataFrame) -> DataFrame:
    """``documents`` with one of each class: the one with the smallest id. Rows without an id
    stay."""
    gone = stored(similar_classes(documents).where("doc_id != class_id")
                  .select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return documents.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
