"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask picks from a run of words; the words under the
mask's gaps may differ, so a passage with substituted words still has seeds in common with its
source. Masks with different gaps make up for each other, and items of 5 to 9, of 10 to 12 and of
more words have masks of their own: whichever words are substituted in an item, or in a run of
``SPAN`` words or more of it, up to a share of 1 - ``IDENTITY``, one seed at least is left.

1. The seeds of all benchmark items are a table, and a bitmap of fixed size that every task gets.
2. One pass over the documents tests the seeds of every text against the bitmap. What passes is
   kept as regions: the hashes of the words around nearby hits, with the seeds that passed.
3. The seeds of the regions are joined to the seed table (this is exact: the bitmap only thins out),
   which gives pairs of region and item.
4. Each pair is verified along the diagonals that its common seeds name: an overlap is the best run
   of positions in which at least ``IDENTITY`` of the words agree, from an agreeing word to another.
   It counts if it has ``SPAN`` words or more, or if the item as a whole agrees in that share, be
   its first or last word substituted or not.

Words are runs of letters and digits, lower-cased. Items of fewer than ``SHORTEST`` words, empty and
null texts are never found. Items of equal words are one item, reported by the smallest id.
Documents are told apart by id; of repeated rows with one id each is looked at, and their overlaps
are those of the id. Rows with a null id are documents of no id: they are reported together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..scale.durable import stored
from .text import mix, words

#: 1: the word counts, 0: any word may stand there.
MASKS = ("1110111", "11010001011", "11001001011", "111011", "11001011", "110100011",
         "11011", "1111", "11101", "10111")
SPAN, IDENTITY, SHORTEST = 13, 0.8, 5
#: The masks of items by the number of words from which they serve. Each row is complete for its
#: lengths, the first one for runs of 13 to 25 words; a longer run can be cut into such runs, and
#: one of them has no larger share of substitutions than the whole.
_SERVE = {SPAN: range(3), 10: range(3, 6), SHORTEST: range(6, 10)}
#: The bitmap: 2**27 bits are 16 MB however large the benchmark is.
BITMAP_BITS = 27
_MARGIN = 64
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mask_seeds(w: np.ndarray, mask: str, number: int) -> np.ndarray:
    count = len(w) - len(mask) + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.full(count, number + 1, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h = h * _STEP + w[i:i + count]
    return mix(h)


def _class_of(count: int) -> int:
    """The key in ``_SERVE`` of an item of ``count`` words."""
    return next((low for low in _SERVE if count >= low), SHORTEST)


def _all_seeds(w: np.ndarray, masks: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    made = [_mask_seeds(w, MASKS[i], i) for i in masks]
    made.append(np.empty(0, np.uint64))  # without items there are no masks
    return np.concatenate(made), np.concatenate([np.arange(len(m)) for m in made])


def item_seeds(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of an item, by the masks for its length, and the word each begins at."""
    return _all_seeds(w, _SERVE[_class_of(len(w))])


def text_seeds(w: np.ndarray, classes: Iterable[int] = tuple(_SERVE)
               ) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a document, which has to meet items of the given classes."""
    return _all_seeds(w, [i for low in classes for i in _SERVE[low]])


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(64 - BITMAP_BITS)
    return (h >> top).astype(np.int64), (mix(h) >> top).astype(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: words(t or "").view(np.int64))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): the hashed words of each distinct item, by a hash of them."""
    return stored(benchmark.select("item_id", _words("text").alias("words"))
                  .where(F.size("words") >= SHORTEST)
                  .groupBy(F.xxhash64("words").alias("item"))
                  .agg(F.min("item_id").alias("item_id"), F.min("words").alias("words")), "items")


def _bitmap(seed_table: DataFrame) -> np.ndarray:
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)

    def bytes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.concatenate(_slots(frame["seed"].to_numpy(np.int64).view(np.uint64)))
            yield pd.DataFrame({"place": at >> 3, "bit": 1 << (at & 7)})

    # A byte of the bitmap per row: at most 2**24, whatever the benchmark.
    made = (seed_table.select("seed").mapInPandas(bytes_of, "place long, bit long")
            .groupBy("place").agg(F.bit_or("bit").alias("bits")).toPandas())
    bits[made["place"].to_numpy(np.int64)] = made["bits"].to_numpy(np.uint8)
    return bits


def _regions(documents: DataFrame, bitmap: np.ndarray, longest: int,
             classes: list[int]) -> DataFrame:
    """(region, doc_id, at, words, seeds): the words around hits of items of ``classes`` that are
    less than ``longest`` apart, from ``longest`` before the first to ``longest`` after the last."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("array<struct<at: long, words: array<long>, seeds: array<long>>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = shared.value

        def passing(h: np.ndarray) -> np.ndarray:
            first, second = _slots(h)
            hit = np.flatnonzero((bits[first >> 3] >> (first & 7).astype(np.uint8)) & 1)
            s = second[hit]
            return hit[((bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1).astype(bool)]

        def regions(text: str | None) -> list[dict]:
            w = words(text or "")
            h, at = text_seeds(w, classes)
            hits = passing(h)
            if not len(hits):
                return []
            hits = hits[np.argsort(at[hits], kind="stable")]
            out = []
            for part in np.split(hits, np.flatnonzero(np.diff(at[hits]) > longest) + 1):
                low = max(0, int(at[part[0]]) - longest)
                high = min(len(w), int(at[part[-1]]) + longest)
                out.append({"at": low, "words": w[low:high].view(np.int64).tolist(),
                            "seeds": np.unique(h[part]).view(np.int64).tolist()})
            return out

        for batch in batches:
            yield batch.map(regions)

    # Or else the filter that inline implies would scan every text once more.
    once = scan.asNondeterministic()
    found = documents.select("doc_id", once("text").alias("found")) \
        .select("doc_id", F.inline("found"))
    return stored(found.withColumn("region", F.xxhash64("doc_id", "at", "words")), "regions")


def best_run(same: np.ndarray) -> tuple[int, int]:
    """The longest [start, end) of a row of booleans that begins and ends in True and has a share
    of True of at least ``IDENTITY``; the first of several."""
    score = np.concatenate(([0], np.cumsum(np.where(same, 1 - IDENTITY, -IDENTITY))))
    score = np.round(score, 9)
    true = np.flatnonzero(same)
    if not len(true):
        return 0, 0
    # Longest i < j with score[j] >= score[i]: a start must be lower than all starts before it.
    low = np.minimum.accumulate(score[true])
    best, start = 0, 0
    for i in true[np.append(True, low[1:] < low[:-1])]:
        later = true[score[true + 1] >= score[i]]
        if later[-1] + 1 - i > best:
            best, start = int(later[-1] + 1 - i), int(i)
    return start, start + best


def overlap(region: np.ndarray, item: np.ndarray) -> tuple[int, int, int] | None:
    """(start, end, words in common) in the region of the best overlap with an item that is long
    enough, along the diagonals of common seeds; None if there is none."""
    own, own_at = item_seeds(item)
    theirs, at = text_seeds(region, [_class_of(len(item))])
    order = np.argsort(own, kind="stable")
    own, own_at = own[order], own_at[order]
    left, right = np.searchsorted(own, theirs, "left"), np.searchsorted(own, theirs, "right")
    diagonals: Counter = Counter()
    for i in np.flatnonzero(right > left):
        for d in at[i] - own_at[left[i]:right[i]]:
            diagonals[int(d)] += 1
    best = None
    for d in sorted(diagonals):
        start, end = max(0, d), min(len(region), d + len(item))
        same = region[start:end] == item[start - d:end - d]
        a, b = best_run(same)
        whole = end - start == len(item) and round(same.mean() - IDENTITY, 9) >= 0
        if (whole or b - a >= SPAN) and (best is None or b - a > best[1] - best[0]):
            best = (start + a, start + b, int(same[a:b].sum()))
    return best


@F.pandas_udf(ArrayType(LongType()))
def _item_seeds(items: pd.Series) -> pd.Series:
    return items.map(lambda w: np.unique(item_seeds(_unsigned(w))[0]).view(np.int64))


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("start", "end", "same")]))
def _overlap(regions: pd.Series, items: pd.Series) -> pd.DataFrame:
    found = [overlap(_unsigned(r), _unsigned(i)) for r, i in zip(regions, items)]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["start", "end", "same"],
                        dtype="Int64")


# A filter on a result, as explode implies one, must not make Spark call a function once more.
_words = _words.asNondeterministic()
_item_seeds = _item_seeds.asNondeterministic()
_overlap = _overlap.asNondeterministic()


def _unsigned(w) -> np.ndarray:
    return np.asarray(w, np.int64).view(np.uint64)


def find_overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, same): overlaps by word positions in the document, one for
    each region and item that overlap, with the number of words that agree."""
    items = benchmark_items(benchmark)
    n = F.size("words")
    kind = F.coalesce(*(F.when(n >= low, low) for low in _SERVE))
    most, classes = items.agg(F.max(n), F.collect_set(kind)).first()
    longest = (most or 0) + _MARGIN
    seed_table = stored(items.select("item", _item_seeds("words").alias("all"))
                        .select("item", F.explode("all").alias("seed")), "seeds")
    regions = _regions(documents, _bitmap(seed_table), longest, classes)
    pairs = (regions.select("region", F.explode("seeds").alias("seed")).join(seed_table, "seed")
             .select("region", "item").distinct())
    met = (pairs.join(regions.select("region", "doc_id", "at", "words").distinct(), "region")
           .join(items.withColumnRenamed("words", "item_words"), "item"))
    return (met.select("doc_id", "item_id", "at", _overlap("words", "item_words").alias("o"))
            .where("o.start IS NOT NULL")
            .select("doc_id", "item_id", (F.col("at") + F.col("o.start")).alias("start"),
                    (F.col("at") + F.col("o.end")).alias("end"), "o.same"))


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_items, items, spans) of the documents that overlap the benchmark; ``spans`` lists
    (start, end, item_id)."""
    spans = find_overlaps(documents, benchmark)
    return spans.groupBy("doc_id").agg(
        F.count_distinct("item_id").alias("n_items"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
        F.sort_array(F.collect_set(F.struct("start", "end", "item_id"))).alias("spans"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that overlap the benchmark."""
    bad = stored(find_overlaps(documents, benchmark).select(F.col("doc_id").alias("_bad"))
                 .distinct(), "contaminated")
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")
