"""Exact search against brute force."""

import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import compare  # noqa: E402

from tagtrail.llm import vector_search as v  # noqa: E402
from tagtrail.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>") \
        .selectExpr("*", "1 AS id", "2 AS dist")


def brute(rows, k, step=5):
    """Over plain integers, of distinct rows that take part."""
    kept = {}
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept[i, tuple(math.floor(256 * float(np.float32(c))) for c in x)] = None
    out = []
    for i, q in kept:
        if i % step == 0:
            best = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(q, x)))), o)
                          for o, x in kept if o != i)[:k]
            out += [(i, r, o, -s) for r, (s, o) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, k, step=5):
    index = v.build(table(spark, rows))
    return sorted(map(tuple, v.top_k(index, F.col("id") % step == 0, k).collect()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_table_against_sql(spark):
    assert compare.difference(QUERIES["op7_vector_search"](spark, FOLDER), compare.connect(FOLDER),
                              ORACLES["op7_vector_search"]) is None


def test_clusters_ties_and_small_cells(spark, monkeypatch):
    monkeypatch.setattr(v, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(v, "CELL_ROWS", 16)
    monkeypatch.setattr(v, "STEP", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 6))
    rows = [(i, (centres[i % 8] + rng.normal(size=6) * 0.05).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]
    assert found(spark, rows, 7) == brute(rows, 7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, [0.5]), (10, []), (15, [1.0, -1.0, 3.0]),
            (1, [2.0, 2.0]), (1, [2.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan]), (6, [inf, 1]),
            (None, [9.0, 9.0]), (20, [-0.001, 0.0])]
    rows = [(i, x if x is None else [None if c is None else float(c) for c in x]) for i, x in rows]
    assert found(spark, rows, 3) == brute(rows, 3)
    assert found(spark, [(0, [1.0])], 5) == []
    assert found(spark, [(0, [1.0]), (7, [1.0])], 5) == [(0, 1, 7, 65536)]
    assert v.build(table(spark, [])) is None


def test_huge_numbers_are_exact(spark):
    rows = [(i, [float(3 ** (i % 23)), 1e7 * i, -2.5]) for i in range(30)]
    assert found(spark, rows, 4) == brute(rows, 4)
    rows = [(i, [1e30 * (-1) ** i, 1.0]) for i in range(6)]
    assert found(spark, rows, 2) == brute(rows, 2)
