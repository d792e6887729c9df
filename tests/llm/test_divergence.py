"""Divergences of sources against exact numbers in Python, and against SQL."""

import os
import random
import re
from collections import Counter, defaultdict

import compare
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import documents

from tagtrail.llm import divergence as dv
from tagtrail.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


def slow(rows):
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = [re.sub("[A-Z]", lambda m: m.group().lower(), t)
                 for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in held[lang].items() if n >= 3]
        sources = {s: c for (k, s), c in counts.items() if k == lang}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        p = {s: shares(c) for s, c in sources.items()}
        q = shares(sum(sources.values(), Counter()))
        for s in sources:
            found = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept
                     if sources[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", found, len(found)), ("term", terms, 200)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, o, v, k) for k, (v, o) in enumerate(ranked, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def random_rows(seed, n=150, sources=6, words=60):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("Aé zé-x b".split()) + chr(97 + min(25, int(rng.expovariate(.2))))
                         + chr(97 + rng.randrange(words) % 26) for _ in range(rng.randrange(40))),
             rng.choice(("en", "de", None)), f"s{min(sources, int(rng.expovariate(.5)))}") for i in range(n)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_table_against_sql(spark):
    assert compare.difference(QUERIES["op13_divergence"](spark, FOLDER), compare.connect(FOLDER),
                              ORACLES["op13_divergence"]) is None


@pytest.mark.parametrize("seed", range(3))
def test_against_slow_form(spark, seed):
    rows = random_rows(seed)
    truth = slow([(r[2], r[3], r[1]) for r in rows])
    assert got(dv.divergences(documents(spark, rows).repartition(5))) == truth


def test_spills_and_small_blocks_give_the_same(monkeypatch):
    rows = random_rows(9, 80)
    table = pa.table({"lang": [r[2] or "" for r in rows], "source": [r[3] for r in rows],
                      "text": [r[1] for r in rows]})
    made = []
    for cells, block, batch in ((1 << 20, 1 << 20, 1000), (10, 7, 3), (40, 30, 50)):
        monkeypatch.setattr(dv, "CELLS", cells)
        monkeypatch.setattr(dv, "BLOCK", block)
        parts = pa.Table.from_batches(dv._fold(table.to_batches(max_chunksize=batch))) \
            .sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])
        kept = pa.Table.from_batches(dv._merge(parts.combine_chunks().to_batches(max_chunksize=batch))) \
            .to_pandas()
        names = sorted(set(table["source"].to_pylist()))
        totals = Counter()
        for lang, sources, counts in zip(kept["lang"], kept["sources"], kept["counts"]):
            for s, n in zip(sources, counts):
                totals[lang, s] += n
        kept["names"] = [names] * len(kept)
        kept["sizes"] = [[totals[x, s] for s in names] for x in kept["lang"]]
        kept["total"] = [sum(s) for s in kept["sizes"]]
        kept["v"] = kept.groupby("lang")["term"].transform("size")
        out = pd.concat(dv._emit(iter([kept.iloc[:20], kept.iloc[20:]])))
        pair = out[out["part"] == "pair"].groupby(["lang", "source", "item"])["value"].sum()
        best = out[out["part"] == "term"].sort_values(["lang", "source", "value", "item"])
        made.append((pair[pair != 0].to_dict(), set(map(tuple, best.to_numpy()))))
    assert made[0] == made[1] == made[2] and made[0][0] and made[0][1]


def test_shares_are_exact_for_large_counts():
    for count, whole in ((0, 3), (10 ** 13, 10 ** 13 + 7), (9 * 10 ** 14, 10 ** 15), (5, 6)):
        assert int(dv.share(np.array([count]), whole)[0]) == 1 + 10 ** 9 * (count + 1) // whole


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, "", "en", "a"), (3, "123 !", "en", "b"),
            (4, "The the THE été", "en", "a"), (5, "the ÉTÉ", "en", None), (6, "the été", "en", "c"),
            (6, "the été", "en", "c"), (None, "the", "en", "a"), (7, "x " * 700_000, "en", "d"),
            (8, "x", "en", "d"), (9, "x y", "en", "d"), (10, "only", "fr", "a"), (11, "one", "fr", "b")]
    truth = slow([(r[2], r[3], r[1]) for r in rows])
    table = documents(spark, rows, extra="value").selectExpr("*", "1 AS rank", "2 AS v", "3 AS part")
    assert got(dv.divergences(table)) == truth and len(truth) > 10
    assert dv.divergences(documents(spark, [])).count() == 0


def test_long_texts_are_counted_without_a_list(monkeypatch):
    text = "Ab-cé 12 AB abéx"
    plain = dv.terms(text)
    monkeypatch.setattr(dv, "_LONG_TEXT", 0)
    assert dv.terms(text) == plain == Counter(
        {"ab".encode(): 2, "cé".encode(): 1, "abéx".encode(): 1})
