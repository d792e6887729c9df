"""Line dedup and the Jaccard join against brute force."""

import difflib
import os
import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents, sentence

from tagtrail.llm import jaccard_join as j
from tagtrail.llm import line_dedup as ld
from tagtrail.llm.queries import QUERIES
from tagtrail.llm.text import shingles

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def solid(text):
    return [x.strip() for x in text.split("\n") if x.strip()]


def brute_lines(rows):
    """Lost line positions per id, by comparing each document with the first of each evidence."""
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    lines = {i: solid(t) for t, i in first.items()}
    held = {}
    for i in sorted(lines):
        ls = lines[i]
        n = [len(x.split()) for x in ls]
        for e in ({(x,) for x, k in zip(ls, n) if k >= 5}
                  | {(x, y) for x, y, a, b in zip(ls, ls[1:], n, n[1:]) if a + b >= 5}):
            held.setdefault(e, []).append(i)
    lost = {}
    for a, b in {(d[0], x) for e, d in held.items() if len(e) == 2 or len(d) <= ld.RARE
                 for x in d[1:]}:
        lost.setdefault(b, set()).update(
            ld.common_blocks(lines[a], lines[b], [len(x.split()) for x in lines[b]]))
    return {i: sorted(lost.get(first[t], ())) for i, t in rows}, first


@needs_tables
def test_line_dedup_of_table_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"])
            for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    truth, first = brute_lines(rows)
    got = QUERIES["op9_line_dedup"](spark, FOLDER).collect()
    assert len(got) == len(rows) and any(truth.values())
    text = dict(rows)
    for r in got:
        assert (r["lines_lost"] or "") == ",".join(map(str, truth[r["doc_id"]]))
        assert r["copy_of"] == (first[text[r["doc_id"]]] != r["doc_id"])


def test_matches_is_a_common_subsequence_like_difflib():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(20))]
        b = [x for x in a if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(12))
        got = ld.matches(a, b)
        assert all(a[i] == b[k] for i, k in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    # Without repeated lines, patience diff finds the longest common subsequence's length.
    a = list(range(30))
    b = [x for x in a if x % 7] + [99]
    assert len(ld.matches(a, b)) == sum(
        m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def brute_blocks(a, b, n, least):
    """All common runs, by comparing every run of ``b`` with every run of ``a``."""
    runs = {tuple(a[i:k]) for i in range(len(a)) for k in range(i + 1, len(a) + 1)}
    return sorted({x for i in range(len(b)) for k in range(i + 1, len(b) + 1)
                   if sum(n[i:k]) >= least and tuple(b[i:k]) in runs for x in range(i, k)})


def test_common_blocks_against_all_runs():
    rng = random.Random(5)
    for _ in range(400):
        size = {x: rng.choice([1, 1, 2, 3, 6]) for x in range(8)}
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(16))] for _ in "ab")
        n = [size[x] for x in b]
        assert ld.common_blocks(a, b, n) == brute_blocks(a, b, n, ld.WORDS)


def test_repeated_and_swapped_passages_go():
    one, two = [1, 2, 3], [4, 5, 6]
    n = [9] * 20
    assert ld.common_blocks([90, *one, 91, *one, 92], [80, *one, 81], n) == [1, 2, 3]
    assert ld.common_blocks([90, *one, 92], [80, *one, 81, *one, 82], n) == [1, 2, 3, 5, 6, 7]
    assert ld.common_blocks([*one, 90, *two], [*two, 80, *one], n) == [0, 1, 2, 4, 5, 6]


def test_blocks_go_from_the_later_document(spark):
    block = "\n".join(sentence(i, 8) for i in range(3))
    own = [sentence(100 + i, 9) for i in range(6)]
    docs = documents(spark, [
        (1, own[0] + "\n" + block + "\n" + own[1]),
        (2, own[2] + "\n\n" + block + "\n\n" + own[3]),
        (3, own[4] + "\n" + own[5])], extra="lines")
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs).collect()}
    assert got == {1: own[0] + "\n" + block + "\n" + own[1], 2: own[2] + "\n\n" + own[3],
                   3: own[4] + "\n" + own[5]}
    assert ld.dedup_lines(docs).columns == docs.columns


def test_common_line_alone_stays_but_large_groups_are_found(spark):
    common = sentence(1, 12)
    apart = [(i, sentence(200 + i, 9) + "\n" + common + "\n" + sentence(500 + i, 9))
             for i in range(30)]
    near = [(100 + i, "\n".join([sentence(2, 9), sentence(3, 9), sentence(900 + i, 9)]))
            for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(documents(spark, apart + near)).collect()}
    assert all(got[i] == t for i, t in apart)
    assert got[100] == near[0][1] and all(got[100 + i] == sentence(900 + i, 9)
                                          for i in range(1, 30))


def test_blocks_of_short_lines_and_unspaced_lines_go(spark):
    verse = "\n".join(sentence(1, 60).split())
    han = "".join(chr(0x4E00 + 37 * i) for i in range(40))
    thai = "".join(chr(0x0E01 + i) for i in range(40))
    rows = [(10 * k + i, f"{sentence(200 + 10 * k + i, 9)}\n{block}\n{sentence(500 + 10 * k + i, 9)}")
            for k, block in enumerate((verse, han, thai, "\n".join("abcd"))) for i in range(2)]
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(documents(spark, rows)).collect()}
    for k, block in enumerate((verse, han, thai)):
        assert got[10 * k] == rows[2 * k][1]
        assert got[10 * k + 1] == rows[2 * k + 1][1].replace(block + "\n", "")
    assert got[31] == rows[7][1]  # four words together are too few


def test_words_of_lines():
    han, thai = chr(0x4E2D), chr(0x0E01)
    text = f"a b c\n{han * 10}\n{han}\nab {han * 4}\n{thai * 12}\n"
    assert ld.lines_of(text)[1].tolist() == [3, 5, 1, 2, 3]
    assert ld.lines_of("")[1].tolist() == []


@pytest.mark.parametrize("holders", [10, 11, 40])
def test_passage_of_one_line_goes_at_any_frequency(spark, holders):
    passage = sentence(1, 50)
    rows = [(i, sentence(200 + i, 9) + "\n" + passage + "\n" + sentence(500 + i, 9))
            for i in range(holders)]
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(documents(spark, rows)).collect()}
    # Whatever the number of holders: the first keeps it, all others lose it and nothing else.
    assert got == {i: t if i == 0 else t.replace(passage + "\n", "") for i, t in rows}


def test_line_dedup_odd_rows(spark):
    text = sentence(1, 20) + "\n" + sentence(2, 20)
    long = "\n".join(sentence(1000 + i, 6) for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, text), (4, text), (5, text), (None, text),
            (6, long), (7, long + "\nmore"), (8, "a\nb\na")]
    docs = documents(spark, rows, extra="lost")
    got = {}
    for r in ld.dedup_lines(docs, report=True).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["copy_of"]))
    assert got[4] == [(text, False)] * 2 and got[5] == got[None] == [("", True)]
    assert got[1] == [(None, False)] and got[2] == [("", False)] and got[3] == [(" \n \n", False)]
    assert got[6] == [(long, False)] and got[7] == [("more", False)] and got[8] == [("a\nb\na", False)]
    left = sorted(r["doc_id"] or 0 for r in ld.dedup_lines(docs, keep_empty=False).collect())
    assert left == [1, 2, 3, 4, 4, 6, 7, 8]
    assert ld.dedup_lines(documents(spark, [])).count() == 0


def brute_links(rows):
    sets = {i: frozenset(shingles(t).tolist()) for i, t in rows}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    reps = {i: s for s, i in first.items()}
    held, links, up = {}, Counter(), {i: i for i in reps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(reps):
        common = Counter(e for x in reps[i] for e in held.get(x, ()))
        for e, n in common.items():
            if n * 10 >= 8 * (len(reps[i]) + len(reps[e]) - n):
                links[i] += 1
                links[e] += 1
                up[max(top(i), top(e))] = min(top(i), top(e))
        for x in reps[i]:
            held.setdefault(x, []).append(i)
    return {i: (top(first[s]), links[first[s]]) if s else (i, 0) for i, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


@needs_tables
def test_jaccard_join_of_table_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"])
            for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert found(QUERIES["op10_jaccard_join"](spark, FOLDER)) == brute_links(rows)


def varied(base, seed, changes):
    rng = random.Random(seed)
    w = base.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(w)


def test_large_group_and_common_passage(spark, monkeypatch):
    monkeypatch.setattr(j, "SMALL", 8)
    monkeypatch.setattr(j, "BLOCK", 16)
    base, passage = sentence(1, 150), sentence(2, 30)
    rows = [(i, varied(base, i, 2)) for i in range(70)]
    rows += [(100 + i, sentence(300 + i, 60) + " " + passage) for i in range(60)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    truth, got = brute_links(rows), found(j.similar_classes(documents(spark, rows)))
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in truth.items()}
    linked, all_links = sum(n for _, n in got.values()), sum(n for _, n in truth.values())
    assert j.RECALL * all_links <= linked <= all_links
    assert all(got[i][1] <= n for i, (_, n) in truth.items())


def test_compare_against_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(20)]
    got = j.compare(sets, np.arange(12), np.arange(5, 20))
    for a in range(12):
        for b in range(15):
            x, y = set(sets[a].tolist()), set(sets[5 + b].tolist())
            assert got[a, b] == (len(x & y) * 10 >= 8 * len(x | y))


def test_jaccard_odd_rows(spark):
    text = sentence(1, 60)
    rows = [(1, None), (2, ""), (3, "!?"), (4, text), (4, text), (5, text.upper() + "!"),
            (None, text), (6, "two words"), (7, "Two  words"), (8, sentence(3, 60_000)), (8, "other"),
            (9, varied(text, 1, 1))]
    docs = documents(spark, rows, extra="class_id")
    got = j.similar_classes(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["class_id"], r["n_links"]))
    assert by[1] == {(1, 0)} and by[2] == {(2, 0)} and by[3] == {(3, 0)}
    assert by[4] == by[5] == by[None] == {(4, 1)} and by[9] == {(4, 1)}
    assert by[6] == by[7] == {(6, 0)} and by[8] == {(8, 0)}
    left = j.near_distinct(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 4, 6, 8, 8]
    assert j.similar_classes(documents(spark, [])).count() == 0


def test_runs_reach_the_recall():
    each = (1 - np.exp(-j.RATE)) ** j.LEVELS
    assert 1 - (1 - each) ** j.runs_needed() >= j.RECALL > 1 - (1 - each) ** (j.runs_needed() - 1)
