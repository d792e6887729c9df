"""The trie of prefixes against one built in memory, and against SQL."""

import hashlib
import os
import random
import re
import zlib

import compare
import pytest
from helpers import sentence
from pyspark.sql import functions as F

from tagtrail.llm import prefix_trie as pt
from tagtrail.llm import scans
from tagtrail.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
         "ends_sha256"]


def regrown(convs):
    new = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        new[c] = convs.get(base, [])[:h] + v[h:]
    return new


def conversations(rows):
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in out.items()}


def slow_nodes(convs):
    member, below = {}, {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            member.setdefault(tuple(v[:d]), []).append(c)
    for k in member:
        if k:
            below.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(member, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in below.get(k, ())) or 1
        saved[k] = (len(member[k]) - 1) * words + sum(saved[x] for x in below.get(k, ()))
    ends = {k: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
            for k, m in member.items()}
    return sorted(((min(m), len(k), min(member[k[:-1]]) if k else None, len(m),
                    len(below.get(k, ())), leaves[k], saved[k],
                    hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in member.items()), key=repr)


def got_nodes(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def random_rows(seed, n=60, family=1):
    rng = random.Random(seed)
    rows = []
    for c in range(0, n * family, family):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(("user", "assistant")), rng.choice(("a b", "c", "d e f"))))
    return rows


@pytest.mark.parametrize("cells", [None, 1 << 3, 1 << 8])
def test_against_trie_in_memory(spark, cells):
    rows = random_rows(1)
    turns = pt.numbered(spark.createDataFrame(rows, SCHEMA).repartition(7))
    # Few cells collide, so that little is proven; nothing may change.
    assert got_nodes(pt.nodes(turns, pt.lengths(turns), cells)) == slow_nodes(conversations(rows))
    assert got_nodes(pt.nodes(*pt.regrown(turns), cells)) == slow_nodes(regrown(conversations(rows)))


def test_sketch_proves_most_singletons_and_no_shared_prefix(spark):
    turns = pt.numbered(spark.createDataFrame(
        [(c, t, "user", f"same {t}" if t < 2 else f"{c} {t}") for c in range(200) for t in range(8)],
        SCHEMA))
    found = pt.prefixes(turns, pt.lengths(turns))
    maybe = pt.maybe_shared(found)
    seen = found.select("depth", maybe(F.col("x"), F.col("y")).alias("m")).collect()
    assert all(r["m"] for r in seen if r["depth"] <= 2)
    assert sum(r["m"] for r in seen if r["depth"] > 2) < 120  # of 1200


@needs_tables
def test_table_against_sql_and_memory(spark):
    assert compare.difference(QUERIES["op12_prefix_trie"](spark, FOLDER), compare.connect(FOLDER),
                              ORACLES["op12_prefix_trie"]) is None
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet").select(*SCHEMA.split()[::2])
    rows = [tuple(r) for r in table.collect()]
    assert got_nodes(pt.prefix_trie(table)) == slow_nodes(conversations(rows))


def test_long_and_hot_conversations_over_partitions(spark):
    rows = [(1, t, "user", f"w {t}") for t in range(1500)]
    rows += [(2, t, "user", f"w {t}") for t in range(1500)]
    rows += [(c, 0, "user", "hello there") for c in range(3, 700)]  # copies
    table = spark.createDataFrame(rows, SCHEMA).repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got_nodes(pt.prefix_trie(table)) == slow_nodes(conversations(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ids_of_a_node_in_many_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(-40, 3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = got_nodes(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == slow_nodes(conversations(rows))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "left out"), (0, None, None, None), (0, 1, "user", ""), (20, 1, "", "x"),
            (7, None, "", ""), (7, 2, "user", "x y"), (9, 5, "a", "bc"), (10, 5, "ab", "c"),
            (-3, 1, "user", "n"), (-20, 1, "user", "n"), (21, 3, "user", sentence(2, 100_000)),
            (41, 3, "user", sentence(2, 100_000)), (60, 1, "r", "t"), (61, 1, "r", "t")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS x", "3 AS at")
    assert got_nodes(pt.prefix_trie(table)) == slow_nodes(conversations(rows))
    assert got_nodes(pt.nodes(*pt.regrown(pt.numbered(table)))) == \
        slow_nodes(regrown(conversations(rows)))
    # Repeated rows are turns of their own.
    twice = [(1, 1, "r", "t"), (1, 1, "r", "t"), (2, 1, "r", "t")]
    assert got_nodes(pt.prefix_trie(spark.createDataFrame(twice, SCHEMA))) == \
        slow_nodes(conversations(twice))
    nothing = spark.createDataFrame([(None, 1, "r", "t")], SCHEMA)
    assert pt.prefix_trie(nothing).count() == 0 and pt.prefix_trie(nothing.limit(0)).count() == 0
    assert pt.nodes(*pt.regrown(pt.numbered(nothing))).count() == 0


def test_running(spark):
    rows = [(i % 3, i * 7919 % 1000, i) for i in range(1000)]
    df = scans.dealt(spark.createDataFrame(rows, "g long, k long, v long"), ["g"], ["k"])
    got = {(r["g"], r["k"]): (r["s"], r["x"]) for r in scans.running(
        df, ["g"], ["k"], {"s": ("sum", F.col("v")), "x": ("xor", F.col("v"))}).collect()}
    for g in range(3):
        total = both = 0
        for k, v in sorted((k, v) for h, k, v in rows if h == g):
            total, both = total + v, both ^ v
            assert got[g, k] == (total, both)
