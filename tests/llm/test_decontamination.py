"""Spaced seeds against exact search, substitutions, odd rows."""

import itertools
import os
import re

import numpy as np
import pytest
from helpers import documents, sentence

from tagtrail.llm import decontamination as d
from tagtrail.llm.queries import QUERIES
from tagtrail.llm.text import words

FOLDER = "/root/testdata/sf0.01"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS doc_id")


def found(spark, docs, items):
    return {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["same"])
            for r in d.find_overlaps(docs, bench(spark, items)).collect()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_table_against_exact_search(spark):
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = [(r["item_id"], plain(r["text"]))
             for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    truth = {(r["doc_id"], i) for r in docs for i, t in items if f" {t} " in f" {plain(r['text'])} "}
    got = {(r["doc_id"], i) for r in QUERIES["op5_decontamination"](spark, FOLDER).collect()
           for i in r["items"] or ()}
    assert truth and truth <= got
    assert {a for a, _ in got} == {a for a, _ in truth}


def test_substituted_words_are_tolerated(spark):
    item = sentence(1, 40)
    changed = item.split()
    for i in range(3, 40, 8):
        changed[i] = "other"
    docs = documents(spark, [
        (1, sentence(2, 30) + " " + item + " " + sentence(3, 30)),
        (2, sentence(4, 200) + " " + " ".join(changed) + " " + sentence(5, 5)),
        (3, sentence(6, 300)),
        (4, " ".join(item.split()[:12]) + " " + sentence(7, 50)),
        (5, " ".join(item.split()[5:18]).upper() + "! " + sentence(8, 50))], extra="item_id")
    got = found(spark, docs, [(7, item)])
    assert set(got) == {(1, 7), (2, 7), (5, 7)}
    assert got[1, 7] == (30, 70, 40) and got[2, 7] == (200, 240, 35) and got[5, 7] == (0, 13, 13)


def test_short_and_equal_items(spark):
    five, four = sentence(11, 5), sentence(12, 4)
    docs = documents(spark, [(1, sentence(1, 9) + " " + five), (2, sentence(2, 9) + " " + four),
                             (3, five)])
    got = found(spark, docs, [(5, five), (4, five.upper()), (1, four), (2, None), (3, "")])
    assert set(got) == {(1, 4), (3, 4)}


def test_best_run_against_all_runs():
    rng = np.random.default_rng(1)
    for _ in range(300):
        same = rng.random(rng.integers(0, 30)) < rng.choice([0.3, 0.7, 0.9])
        a, b = d.best_run(same)
        longest = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1)
                       if same[i:j].mean() >= d.IDENTITY - 1e-9 and same[i] and same[j - 1]),
                      default=0)
        assert b - a <= len(same) and (b == a or same[a:b].mean() >= d.IDENTITY - 1e-9)
        assert b - a >= longest - 1


@pytest.mark.parametrize("n", range(5, 21))
def test_every_substitution_pattern_is_found(n):
    item, around = words(sentence(31, n)), words(sentence(32, 60))
    for gone in itertools.combinations(range(n), n // 5):
        inside = item.copy()
        inside[list(gone)] = np.arange(len(gone), dtype=np.uint64)
        kept = sorted(set(range(n)) - set(gone))
        got = d.overlap(np.concatenate([around[:30], inside, around[30:]]), item)
        assert got == (30 + kept[0], 31 + kept[-1], len(kept)), gone
    # One more substitution than a fifth is no overlap.
    inside[:n // 5 + 1] = np.arange(n // 5 + 1, dtype=np.uint64)
    inside[n // 5 + 1:] = item[n // 5 + 1:]
    if n - n // 5 - 1 < d.SPAN:
        assert d.overlap(inside, item) is None


@pytest.mark.parametrize("n", range(13, 26))
def test_masks_are_complete_for_runs_inside_an_item(n):
    gone = np.array(list(itertools.combinations(range(n), n // 5)))
    gone = np.bitwise_or.reduce(1 << gone, axis=1)
    left = np.ones(len(gone), bool)
    for i in d._SERVE[d.SPAN]:
        picked = sum(1 << k for k, bit in enumerate(d.MASKS[i]) if bit == "1")
        for at in range(n - len(d.MASKS[i]) + 1):
            left &= (gone & (picked << at)) != 0
    assert not left.any()


def test_substituted_ends_and_sparse_agreement(spark):
    items = {i: sentence(60 + i, n) for i, n in enumerate((13, 10, 15, 11))}
    gone = {0: (0, 12), 1: (3, 6), 2: (3, 7, 11), 3: (3, 7)}
    docs = []
    for i, item in items.items():
        changed = item.split()
        for k in gone[i]:
            changed[k] = "other"
        docs.append((i, sentence(80 + i, 30) + " " + " ".join(changed) + " " + sentence(90 + i, 30)))
    assert set(found(spark, documents(spark, docs), list(items.items()))) == {(i, i) for i in items}


def test_seeds_do_not_depend_on_place():
    w = words(sentence(3, 60))
    inner, _ = d.item_seeds(w[20:45])
    assert set(inner.tolist()) <= set(d.text_seeds(w)[0].tolist())


def test_odd_rows(spark):
    item = sentence(1, 30)
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item),
            (4, (item + " ") * 500), (5, sentence(9, 60_000) + " " + item)]
    docs = documents(spark, rows, extra="start")
    items = bench(spark, [(1, item), (1, item), (None, sentence(50, 20))])
    got = {r["doc_id"]: r for r in d.contaminated(docs, items).collect()}
    assert set(got) == {3, None, 4, 5}
    assert [tuple(s) for s in got[5]["spans"]] == [(60_000, 60_030, 1)]
    left = d.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2]
    assert d.decontaminate(docs, bench(spark, [])).count() == len(rows)
    assert d.decontaminate(documents(spark, []), items).count() == 0
