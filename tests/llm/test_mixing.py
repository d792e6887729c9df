"""Targets and fair queueing against a slow form."""

import os
import re

import pytest
from helpers import documents

from tagtrail.llm import mixing
from tagtrail.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def slow_targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Share, stop those above three times their size, share the excess anew."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        goal = [3.0 * s if i in capped else left * weights[i] / w if w else 0.0
                for i, s in enumerate(sizes)]
        above = {i for i, g in enumerate(goal) if g > 3 * sizes[i] + 1e-9}
        if not above:
            return goal
        capped |= above


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5, 0, 70, 3, 2], [0, 0], [5],
                                   [1, 1, 1000], [1000, 1, 1, 1, 1, 1]])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)],
                                  "source string, source_size long")
    got = mixing.targets(mixing.cyclic_weights(table)).orderBy("place").collect()
    weights = [(1.0, 2.0, 3.0)[i % 3] for i in range(len(sizes))]
    assert [r["weight"] for r in got] == weights
    assert [r["target"] for r in got] == pytest.approx(slow_targets(sizes, weights))


def slow_mix(queues: dict, targets: dict, budget: int) -> dict:
    """Copies per document, from queues of (size, id) in shuffled order."""
    items = []
    for s, queue in queues.items():
        at, whole = 0, sum(n for n, _ in queue)
        for turn in range(3):
            for n, i in queue:
                if turn * whole + at % max(whole, 1) < targets[s]:
                    items.append(((turn * whole + at % max(whole, 1) + n) / targets[s], s, i, n))
                at += n
    out, used = {}, 0
    for _, _, i, n in sorted(items):
        used += n
        if used > budget:
            break
        out[i] = out.get(i, 0) + 1
    return out


def test_copies_against_slow_form(spark):
    rows = [(i, "w " * (1 + i * 37 % 11), "en", "abcd"[min(3, i % 9)]) for i in range(400)]
    got = mixing.mix(documents(spark, rows)).collect()
    order = {r["doc_id"]: r["finish"] for r in got}
    queues, goal = {}, {}
    for r in sorted(got, key=lambda r: order[r["doc_id"]]):
        queues.setdefault(r["source"], []).append((r["size"], r["doc_id"]))
        goal[r["source"]] = r["target"]
    truth = slow_mix(queues, goal, sum(r["size"] for r in got))
    assert {r["doc_id"]: r["copies"] for r in got if r["copies"]} == truth
    again = mixing.mix(documents(spark, rows).repartition(13)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_table_meets_its_targets(spark):
    got = QUERIES["op8_mixing"](spark, FOLDER).toPandas()
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().set_index("doc_id")["text"]
    size = texts.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert (got.set_index("doc_id")["size"] == size.reindex(got["doc_id"])).all()
    assert (got["taken"] <= 3 * got["size"]).all() and got["taken"].sum() <= got["size"].sum()
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max()


def test_plan_is_native(spark):
    df = mixing.mix(documents(spark, [(1, "a b"), (2, "c", "en", "b")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c", "en", None), (3, "a b c", "en", None),
            (None, "x y", "en", "b"), (4, "w " * 100_000, "en", "b"), (5, "a b\x0bc")]
    got = mixing.mix(documents(spark, rows, extra="finish")).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 3, 3, 100_000]
    assert {r["source_size"] for r in got if r["source"] is None} == {6}
    assert all(r["taken"] == r["copies"] * r["size"] for r in got)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(documents(spark, [(1, ""), (2, None)])).collect()] == [0, 0]


def test_running_sum(spark):
    rows = [(i % 3, i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(6)
    got = {(r["g"], r["k"], r["v"]): r["s"]
           for r in mixing.running_sum(df, ["k", "v"], "v", "s", ["g"]).collect()}
    for g in range(3):
        total = 0
        for k, v in sorted((k, v) for h, k, v in rows if h == g):
            total += v
            assert got[g, k, v] == total
