"""SimHash near-duplicates by multi-index hashing.

A text's words are its runs of anything but space, tab and line ends, with A-Z lower-cased. Every
three consecutive words, repeats included, are hashed by XXH64 with seed 42; a fingerprint bit is 1
where over half of the hashes have it set. Documents whose fingerprints differ in ``RADIUS`` bits at
most are linked, and components follow the links.

Each distinct fingerprint is cut into two segments of 32 bits, with a table for each that holds the
fingerprints by the value of the segment. Of two differing bits either one at most lies in the first
segment, or none in the second. So a fingerprint looks up the ball of radius 1 around its first
segment and the value of its second one, and what these buckets hold is verified on all 64 bits. As
one side of a pair has a 0 where the first segments differ, only zeros are flipped: some 18 look-ups
a fingerprint.

A bucket keeps ``BUCKET`` fingerprints at most. Fingerprints that hold or look up a fuller one (those
of large groups of near copies) meet by whole balls instead: two fingerprints differ in two bits at
most if and only if a third differs from each of them in one at most, so each is sent to the 65
words within one bit of it, and what meets there is linked to the smallest. Nobody meets more than
64 others at a word, no links are lost, and work is in proportion to the fingerprints.

A text of one or two words has one shingle, all its words. Null and empty texts, and texts without a
word, have fingerprint zero, and are linked like any other. A row is a document: rows that repeat an
id are linked by their own texts. Null ids are reached and reach others, but name no component; a
component of null ids alone has none. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..operators.components import connected_components
from ..scale.durable import stored

GRAM, SEED, RADIUS = 3, 42, 2
BUCKET = 64
_HALF = 32
_CHUNK = 1 << 16


def fingerprint(text: str | None, gram: int = GRAM) -> int:
    """The fingerprint as an unsigned number."""
    from xxhash import xxh64_intdigest as digest

    # Bytes are lower-cased and split as ASCII: the rest of UTF-8 stays as it is.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = max(1, len(words) - gram + 1)
    set_bits = np.zeros(64, np.int64)
    for low in range(0, n, _CHUNK):
        high = min(n, low + _CHUNK)
        hashes = np.array([digest(whole[a:b - 1], SEED) for a, b in zip(
            starts[low:high], ends[min(gram, len(words)) - 1 + low:])], dtype="<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp), a row per row of ``documents``; ``fp`` holds the 64 bits as a signed number."""
    return documents.select("doc_id", _fingerprint("text").alias("fp"))


def digits(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _cell(segment: int, value: Column) -> Column:
    return F.struct(F.lit(segment).alias("segment"), value.alias("value"))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): links between the distinct fingerprints ``fp`` that differ in two bits at most.
    Every such pair is linked, in a dense region by way of others."""
    first, second = F.shiftrightunsigned("fp", _HALF), F.col("fp").bitwiseAND((1 << _HALF) - 1)
    held = fps.select("fp", F.explode(F.array(_cell(0, first), _cell(1, second))).alias("c")) \
        .select("fp", "c.*")
    # One more than a bucket keeps shows that it is too full.
    order = Window.partitionBy("segment", "value").orderBy("fp")
    tables = stored(held.withColumn("k", F.row_number().over(order)).where(F.col("k") <= bucket + 1)
                    .groupBy("segment", "value").agg(F.collect_list("fp").alias("held"))
                    .where("segment = 0 OR size(held) > 1"), "tables")
    bits = F.array(*[F.lit(1 << k).cast("long") for k in range(_HALF)])
    ball = F.transform(F.filter(bits, lambda b: first.bitwiseAND(b) == 0),
                       lambda b: _cell(0, first.bitwiseXOR(b)))
    probes = fps.select("fp", F.explode(F.concat(F.array(_cell(0, first), _cell(1, second)), ball))
                        .alias("c")).select("fp", "c.*", (F.col("c.value") == F.when(
                            F.col("c.segment") == 0, first).otherwise(second)).alias("own"))
    near = F.filter("held", lambda x: (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= RADIUS)
                    & (~F.col("own") | (x > F.col("fp"))))
    full = F.size("held") > bucket
    met = stored(probes.join(tables, ["segment", "value"]).select(
        "fp", full.alias("full"), F.when(~full, near).alias("near"))
        .where("full OR size(near) > 0"), "met")
    direct = met.select(F.col("fp").alias("src"), F.explode("near").alias("dst"))
    crowded = met.where("full").select("fp").distinct()
    within_one = F.concat(F.array("fp"), F.transform(
        F.array(*[F.lit(1 << k if k < 63 else -1 << 63).cast("long") for k in range(64)]),
        lambda b: F.col("fp").bitwiseXOR(b)))
    stars = crowded.select("fp", F.explode(within_one).alias("word")).groupBy("word") \
        .agg(F.min("fp").alias("src"), F.collect_list("fp").alias("all")).where("size(all) > 1") \
        .select("src", F.explode("all").alias("dst")).where("src <> dst")
    return direct.union(stars).distinct()


def near_duplicates(documents: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id), a row per row of ``documents``: the fingerprint, and the smallest
    id that links reach from the document, itself included."""
    rows = stored(fingerprints(documents), "fingerprints")
    firsts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    found = stored(links(firsts.select("fp"), bucket), "links")
    linked = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    parts = stored(connected_components(linked, found), "components")
    named = parts.join(firsts, F.col("id") == F.col("fp")).groupBy("component") \
        .agg(F.min("doc_id").alias("least"))
    of_fp = parts.join(named, "component").select(F.col("id").alias("fp"), "least")
    # Written first, so that a join to a frequent fingerprint can be split.
    classes = stored(firsts.join(of_fp, "fp", "left").select(
        "fp", F.coalesce("least", "doc_id").alias("component_id")), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")
