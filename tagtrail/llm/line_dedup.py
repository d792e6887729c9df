"""Line deduplication by pairwise comparison of overlapping documents.

1. Every distinct text is reduced to the hashes of its lines (one pass; texts stay where they are).
2. Evidence of an overlap is, at any frequency, a line of ``PASSAGE`` words or more, two
   neighbouring lines of ``WORDS`` words together, or as many more neighbouring lines as it takes to
   reach ``WORDS`` words: large groups of near copies share runs of lines.
   A line of ``WORDS`` words or more that is shorter than a passage is evidence while it is rare (in
   ``RARE`` distinct texts at most); a common one by itself, such as a notice, says nothing and
   stays. Each document is paired with the first document that holds a piece of evidence: links
   grow with the number of lines, never with the square of a group.
3. In each pair, every run of lines of ``WORDS`` words or more in total that stands in both
   documents is deleted from the later one, wherever and however often it stands in either. Such a
   run is covered by its shortest runs of ``WORDS`` words, so these alone are looked up: the time is
   linear in the lines.

The earlier document is the one with the smaller id (null ids last, then the smaller text hash). A
text that an earlier document has as it is loses all its lines, without a comparison. A line is
compared without white space at its ends. Its words are its runs between white space or, where a
script sets no spaces, one for each two code points (Chinese, Japanese) or four (Thai, Lao, Burmese,
Khmer), whichever is more. Blank lines are not counted as lines and go with the
block around them. Null and empty texts stay as they are. Rows that repeat both id and text are one
document and are treated alike; other columns stay, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..scale.durable import stored
from .text import codes, is_kind, mix, runs, span_hashes

WORDS, RARE, PASSAGE = 5, 10, 50
#: First and last code points of scripts without spaces, and quarters of a word that each stands for.
_UNSPACED = ((0x0E00, 0x0EFF, 1), (0x1000, 0x109F, 1), (0x1780, 0x17FF, 1), (0x3040, 0x30FF, 2),
             (0x3400, 0x4DBF, 2), (0x4E00, 0x9FFF, 2), (0xF900, 0xFAFF, 2), (0x20000, 0x323AF, 2))


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line that isn't blank."""
    p = codes(text)
    blank = is_kind(p, "space")
    ends = np.append(np.flatnonzero(p == 10), len(p))
    starts = np.append(0, ends[:-1] + 1)
    solid = np.flatnonzero(~blank)
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends)
    kept = last > first
    starts, ends = solid[first[kept]], solid[last[kept] - 1] + 1
    word_starts, _ = runs(~blank)
    n = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    if len(p) and p.max() >= _UNSPACED[0][0]:
        quarters = np.zeros(len(p) + 1, np.int64)
        for low, high, each in _UNSPACED:
            quarters[1:] += each * ((p >= low) & (p <= high))
        quarters = np.cumsum(quarters)
        n = np.maximum(n, (quarters[ends] - quarters[starts]) // 4)
    return span_hashes(p, starts, ends), n


_LINES = StructType([StructField("lines", ArrayType(LongType())),
                     StructField("words", ArrayType(IntegerType()))])


@F.pandas_udf(_LINES)
def _lines(texts: pd.Series) -> pd.DataFrame:
    made = [lines_of(t or "") for t in texts]
    return pd.DataFrame({"lines": [h.view(np.int64) for h, _ in made],
                         "words": [n.astype(np.int32) for _, n in made]})


_EVIDENCE = ArrayType(StructType([StructField("hash", LongType()), StructField("runs", LongType())]))


@F.pandas_udf(_EVIDENCE)
def _evidence(lines: pd.Series, words: pd.Series) -> pd.Series:
    """Distinct (hash, 0) of single lines, (hash, 1) of runs of lines and (hash, 2) of passages."""
    out = []
    for h, n in zip(lines, words):
        h, n = np.asarray(h, np.int64).view(np.uint64), np.asarray(n)
        one, whole = np.unique(h[(n >= WORDS) & (n < PASSAGE)]), np.unique(h[n >= PASSAGE])
        total, run, several = n, h, []
        for k in range(1, min(WORDS, len(h))):  # a line has a word at least
            before, total = total[:-1], total[:-1] + n[k:]
            run = mix(run[:-1] * np.uint64(3) + h[k:])
            several.append(run[(total >= WORDS) & ((before < WORDS) | (k == 1))])
        two = np.unique(np.concatenate(several)) if several else h[:0]
        out.append([{"hash": x, "runs": 0} for x in one.view(np.int64).tolist()]
                   + [{"hash": x, "runs": 1} for x in two.view(np.int64).tolist()]
                   + [{"hash": x, "runs": 2} for x in whole.view(np.int64).tolist()])
    return pd.Series(out)


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: pairs of positions of equal lines, increasing in both. It leaves out repeated
    and swapped passages, so deletions don't rest on it."""
    found: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b[x] == 1}
        anchors = _increasing([(at[x], j) for j, x in enumerate(b[b0:b1], b0) if x in at])
        if not anchors:
            continue
        found += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])
                 if i + 1 < k and j + 1 < m]
    return sorted(found)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising second entry, whose first entries rise too."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        pile = bisect_left(tops, i)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(i)
            piles.append(k)
        else:
            tops[pile], piles[pile] = i, k
    out = []
    k = piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _shortest_runs(lines: list, size: dict, least: int) -> Iterator[tuple[int, int]]:
    """[start, end) of the shortest runs of ``least`` words from each line on and up to each line,
    among lines that have a size."""
    for step in (1, -1):
        for i in range(len(lines)):
            total, k = 0, i
            while 0 <= k < len(lines) and lines[k] in size:
                total += size[lines[k]]
                if total >= least:
                    yield min(i, k), max(i, k) + 1
                    break
                k += step


def common_blocks(earlier: list, later: list, words: list, least: int = WORDS) -> list[int]:
    """Positions of the lines of ``later`` in runs of ``least`` words or more that ``earlier`` has."""
    size = dict(zip(later, words))
    held = {tuple(earlier[a:b]) for a, b in _shortest_runs(earlier, size, least)}
    out: set[int] = set()
    for a, b in _shortest_runs(later, size, least):
        if tuple(later[a:b]) in held:
            out.update(range(a, b))
    return sorted(out)


@F.pandas_udf(ArrayType(IntegerType()))
def _deleted(earlier: pd.Series, later: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([common_blocks(a.tolist(), b.tolist(), n.tolist())
                      for a, b, n in zip(earlier, later, words)], dtype=object)


def _place(doc_id: Column, text_hash: Column) -> Column:
    """Documents in order: null ids last."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), text_hash.alias("text"))


def deletions(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text_hash, place) of the first document with each text, and (place, lines) of the line
    positions that the first documents lose."""
    digest = F.struct(F.xxhash64("text"), F.xxhash64(F.lit("again"), F.col("text")))
    texts = stored(documents.where("text != ''").select(
        _place(F.col("doc_id"), digest).alias("place"), _lines("text").alias("l"))
        .select("place", "l.lines", "l.words"), "lines")
    firsts = texts.groupBy(F.col("place.text").alias("text_hash")).agg(F.min("place").alias("place"))
    # One document per distinct text; repeated rows are one as well.
    distinct = stored(texts.join(firsts.select("place"), "place").dropDuplicates(["place"]),
                      "distinct_lines")
    evidence = distinct.select("place", _evidence("lines", "words").alias("all")) \
        .select("place", F.explode("all").alias("e")).select("place", "e.hash", "e.runs")
    shared = evidence.groupBy("hash", "runs").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n")) \
        .where(f"n > 1 AND (runs > 0 OR n <= {RARE})")
    pairs = (evidence.join(shared, ["hash", "runs"]).where("place != first")
             .select("first", "place").distinct())
    met = (pairs.join(distinct, "place")
           .join(distinct.select(F.col("place").alias("first"), F.col("lines").alias("earlier")),
                 "first"))
    lost = (met.select("place", _deleted("earlier", "lines", "words").alias("all"))
            .select("place", F.explode("all").alias("line")).groupBy("place").agg(F.sort_array(F.collect_set("line")).alias("lost")))
    return firsts, lost


@F.pandas_udf(StringType())
def _without(texts: pd.Series, lost: pd.Series) -> pd.Series:
    """Texts without the lines at positions ``lost``, counting lines that aren't blank."""
    return pd.Series([t if n is None else without_lines(t, set(n.tolist()))
                      for t, n in zip(texts, lost)], dtype=object)


# A filter on a result, as explode implies one, must not make Spark call a function once more.
_lines, _evidence = _lines.asNondeterministic(), _evidence.asNondeterministic()
_deleted, _without = _deleted.asNondeterministic(), _without.asNondeterministic()


def without_lines(text: str, lost: set[int]) -> str:
    kept, k, gone = [], 0, False
    for line in text.split("\n"):
        if line.strip():
            gone = k in lost
            k += 1
        if not gone:
            kept.append(line)
    return "\n".join(kept)


def dedup_lines(documents: DataFrame, report: bool = False, keep_empty: bool = True) -> DataFrame:
    """``documents`` with common blocks deleted from the later document. Without
    ``keep_empty``, documents of which nothing is left go, if they were not blank before. With
    ``report`` also ``lines_lost``, the positions of the deleted lines among those that aren't blank
    (null where none are), and ``copy_of``, whether an earlier document has the same text."""
    firsts, lost = deletions(documents)
    digest = F.struct(F.xxhash64("text"), F.xxhash64(F.lit("again"), F.col("text")))
    marked = documents.withColumn("_place", F.when(F.col("text") != "",
                                                   _place(F.col("doc_id"), digest)))
    plan = firsts.join(lost, "place", "left").select(
        F.col("text_hash").alias("_hash"), F.col("place").alias("_first"),
        F.col("lost").alias("_lost"))
    joined = marked.join(plan, F.col("_place.text") == F.col("_hash"), "left")
    copy = F.coalesce(F.col("_place") != F.col("_first"), F.lit(False))
    out = joined.withColumn("_copy", copy).withColumn("_old", F.col("text")) \
        .withColumn("text", F.when(copy, F.lit("")).when(
            F.col("_lost").isNotNull(), _without("text", "_lost")).otherwise(F.col("text")))
    if not keep_empty:
        out = out.withColumn("_blank", F.col("_old").rlike(r"^\s*$")) \
            .where(F.coalesce(~F.col("text").rlike(r"^\s*$") | F.col("_blank"), F.lit(True)))
    names = [F.col(c) for c in documents.columns]
    if report:
        names += [F.col("_lost").alias("lines_lost"), F.col("_copy").alias("copy_of")]
    return out.select(*names)
