"""Audit of how the sources of each language diverge in their words, by in-mapper stripes.

Each task folds whole documents into stripes, one for a term of a language: the number of documents
that hold it and its occurrences in each source. When a task holds ``CELLS`` cells it spills them.
Cells are merged to whole stripes as a sorted stream, so that a task holds one stripe at a time, and
stripes in ``LEAST_DOCUMENTS`` documents are kept. Merged stripes directly give the divergences: blocks of
terms by sources, from which each task folds its pair sums and its best ``TOP`` terms of each source.
Two sources in which a term does not occur give the same value for every such term, so that value
counts once for all of them.

Terms are runs of letters A-Z, a-z and of code points from 128 on, with A-Z lower-cased. A share is
p = 1 + floor(10^9 (count + 1) / (N + V)), with N the occurrences of the V kept terms of the language
in the source, or in the whole language. The value of a source's p against q is
floor((p - q)^2 / q). All is exact: shares are divided digit by digit in 64-bit integers, for up to
9 * 10^15 occurrences.

Null text, language and source are empty; a document without a term still makes its source occur.
Rows that repeat an id are documents of their own, and ids are not read. Ties in value are settled by
the item's UTF-8 order. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale.durable import stored

LEAST_DOCUMENTS, TOP, SCALE = 3, 200, 10 ** 9
#: Cells of stripes that a task holds before it spills, and numbers in a block of terms by sources.
CELLS, BLOCK = 600_000, 2_000_000
_LONG_TEXT = 1 << 20

_LETTER = re.compile(rb"[a-z\x80-\xff]+")
_FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
                for b in range(256))


def terms(text: str) -> Counter:
    """Occurrences of each term, as UTF-8. The bytes of a code point from 128 on are all above
    127."""
    plain = text.encode("utf-8", "surrogatepass").translate(_FOLDED)
    if len(plain) > _LONG_TEXT:
        return Counter(m.group() for m in _LETTER.finditer(plain))
    return Counter(plain.split())


_CELL = "lang string, term string, source string, n long, documents long"
_STRIPE = "lang string, term string, n_documents long, sources array<string>, counts array<long>"
#: A cell of a stripe holds occurrences below this bit and documents from it on.
_DOCUMENTS = 40
_MOST_DOCUMENTS = 1 << 22


def _spilled(cells: dict) -> Iterator[pa.RecordBatch]:
    """The cells of all stripes, a batch for each language and source."""
    for (lang, source), by_term in cells.items():
        packed = np.fromiter(by_term.values(), np.int64, len(by_term))
        same = pa.array(np.zeros(len(by_term), np.int32))
        yield pa.RecordBatch.from_arrays([
            pa.array([lang]).take(same), pa.array(list(by_term), pa.binary()).cast(pa.string()),
            pa.array([source]).take(same), pa.array(packed & ((1 << _DOCUMENTS) - 1)),
            pa.array(packed >> _DOCUMENTS)], names=["lang", "term", "source", "n", "documents"])


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of the documents of a task, held as their cells: occurrences and documents of a term in a
    source of a language. One dict a source costs a third of one dict a term, as most terms are rare. A
    document has one source, so that the documents of a stripe's cells add up."""
    cells: dict[tuple[str, str], dict[bytes, int]] = {}
    held = documents = 0
    one = 1 << _DOCUMENTS
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            by_term = cells.setdefault((lang, source), {})
            before, get = len(by_term), by_term.get
            for term, n in terms(text).items():
                by_term[term] = get(term, 0) + n + one
            held += len(by_term) - before
            documents += 1
            if held >= CELLS or documents >= _MOST_DOCUMENTS:
                yield from _spilled(cells)
                cells, held, documents = {}, 0, 0
    yield from _spilled(cells)


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _added(cells: pa.Table) -> pa.Table:
    """Sorted cells with those of one source and stripe added up."""
    columns = {c: cells.column(c).combine_chunks() for c in cells.column_names}
    at = _starts(columns["lang"], columns["term"], columns["source"])
    return pa.table({c: pa.array(np.add.reduceat(columns[c].to_numpy(), at)) if c in ("n", "documents")
                     else columns[c].take(pa.array(at)) for c in columns})


def _kept(cells: pa.Table) -> pa.RecordBatch:
    """Stripes in enough documents, from whole sorted stripes with cells added up."""
    columns = {c: cells.column(c).combine_chunks() for c in cells.column_names}
    at = _starts(columns["lang"], columns["term"])
    held = np.add.reduceat(columns["documents"].to_numpy(), at)
    sizes = np.diff(np.append(at, len(cells)))
    kept = held >= LEAST_DOCUMENTS
    inside = pa.array(np.flatnonzero(np.repeat(kept, sizes)))
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes[kept]))).astype(np.int32))
    first = pa.array(at[kept])
    return pa.RecordBatch.from_arrays(
        [columns["lang"].take(first), columns["term"].take(first), pa.array(held[kept]),
         pa.ListArray.from_arrays(ends, columns["source"].take(inside)),
         pa.ListArray.from_arrays(ends, columns["n"].take(inside))],
        names=["lang", "term", "n_documents", "sources", "counts"])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole stripes from a stream of cells sorted by language, term and source. What is held of the
    last stripe is a cell for each source."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = pa.Table.from_batches([batch])
        cells = _added(cells if held is None else pa.concat_tables([held, cells]))
        last = int(_starts(*(cells.column(c).combine_chunks() for c in ("lang", "term")))[-1])
        if last:
            yield _kept(cells.slice(0, last))
        held = cells.slice(last)
    if held is not None:
        yield _kept(held)


def stripes(documents: DataFrame) -> DataFrame:
    """(lang, term, n_documents, sources, counts) of the kept terms."""
    filled = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    order = ["lang", "term", "source"]
    return stored(filled.mapInArrow(_fold, _CELL).repartition("lang", "term")
                  .sortWithinPartitions(*order).mapInArrow(_merge, _STRIPE), "stripes")


def share(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole), three decimal digits at a time."""
    out, rest = np.divmod(np.asarray(count, np.int64) + 1, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def _value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Sums:
    """Pair sums of a task: over the terms, the value less that of two sources without the term."""

    def __init__(self, block: int):
        self.block, self.held, self.by_lang = block, 0, {}

    def add(self, lang: str, names: list, p: np.ndarray, without: np.ndarray) -> Iterator[pd.DataFrame]:
        s = len(names)
        width = max(1, min(s, self.block // s))
        step = max(1, self.block // (s * width))
        for low in range(0, s, width):
            q0 = without[None, low:low + width]
            base = _value(without[:, None], q0)
            part = np.zeros((s, q0.shape[1]), np.int64)
            for t in range(0, len(p), step):
                block = p[t:t + step]
                part += (_value(block[:, :, None], block[:, None, low:low + width]) - base).sum(axis=0)
            if (lang, low) in self.by_lang:
                self.by_lang[lang, low][1][:] += part
            else:
                self.by_lang[lang, low] = names, part
                self.held += part.size
            if self.held > 2 * self.block:
                yield from self.flush()

    def flush(self) -> Iterator[pd.DataFrame]:
        for (lang, low), (names, part) in self.by_lang.items():
            x, y = np.nonzero(part)
            at = np.array(names, dtype=object)
            yield pd.DataFrame({"lang": lang, "source": at[x], "part": "pair", "item": at[low + y],
                                "value": part[x, y]})
        self.by_lang, self.held = {}, 0


def _best(frames: list[pd.DataFrame]) -> pd.DataFrame:
    whole = pd.concat(frames, ignore_index=True)
    return whole.sort_values(["value", "item"], ascending=[False, True]) \
        .groupby(["lang", "source"], sort=False).head(TOP)


def _emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pair sums and the best terms of a task's merged stripes."""
    sums, found, rows = _Sums(BLOCK), [], 0
    for frame in frames:
        for lang, part in frame.groupby("lang", sort=False):
            first = part.iloc[0]
            names, v = list(first["names"]), int(first["v"])
            sizes = np.asarray(first["sizes"], np.int64) + v
            place = {name: i for i, name in enumerate(names)}
            # As many terms at a time as a block of terms by sources holds.
            step = max(1, BLOCK // len(names))
            for low in range(0, len(part), step):
                some = part.iloc[low:low + step]
                count = np.zeros((len(some), len(names)), np.int64)
                at = np.repeat(np.arange(len(some)), some["sources"].map(len))
                count[at, [place[x] for xs in some["sources"] for x in xs]] = \
                    np.concatenate(some["counts"].to_numpy())
                p = share(count, sizes)
                q = share(count.sum(axis=1), int(first["total"]) + v)[:, None]
                yield from sums.add(lang, names, p, share(np.zeros(len(names)), sizes))
                term, source = np.nonzero((count > 0) & (p > q))
                found.append(pd.DataFrame({
                    "lang": lang, "source": np.array(names, dtype=object)[source], "part": "term",
                    "item": some["term"].to_numpy()[term], "value": _value(p, q)[term, source]}))
                rows += len(term)
        if rows > 2 * CELLS:
            found = [_best(found)]
            rows = len(found[0])
            if rows > CELLS:  # more sources than a task holds
                yield found.pop()
                rows = 0
    if found:
        yield _best(found)
    yield from sums.flush()


def divergences(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source of a language, in part "pair" the
    other sources by how far it diverges from them over all kept terms, and in part "term" its
    ``TOP`` terms that are the most above the language."""
    kept = stripes(documents)
    sizes = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")) \
        .groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    volumes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    occur = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = stored(occur.join(sizes, ["lang", "source"], "left").join(volumes, "lang", "left")
                    .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in "nv"]),
                    "groups")
    # The result has a row for each pair of sources, so a list of sources is the lesser part of it.
    languages = groups.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("all"), F.max("v").alias("v"),
        F.sum("n").alias("total"))
    languages = stored(languages.select("lang", "v", "total", F.col("all.source").alias("names"),
                                        F.col("all.n").alias("sizes")), "languages")
    schema = "lang string, source string, part string, item string, value long"
    made = stored(kept.drop("n_documents").join(languages, "lang").mapInPandas(_emit, schema), "made")

    none = F.when(F.col("v") > 0, F.expr(f"1 + {SCALE} div (n + v)"))
    ours = groups.select("lang", "source", "v", none.alias("p"))
    theirs = groups.select("lang", F.col("source").alias("item"), none.alias("q"))
    deltas = made.where("part = 'pair'").groupBy("lang", "source", "item") \
        .agg(F.sum("value").alias("delta"))
    pairs = ours.join(theirs, "lang").where("source <> item") \
        .join(deltas, ["lang", "source", "item"], "left") \
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(
            F.expr("v * (((p - q) * (p - q)) div q)"), F.lit(0)).alias("base"), "delta") \
        .select("lang", "source", "part", "item",
                (F.col("base") + F.coalesce("delta", F.lit(0))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    place = F.row_number().over(order).alias("rank")
    return pairs.select("*", place).union(
        made.where("part = 'term'").select("*", place).where(F.col("rank") <= TOP))
