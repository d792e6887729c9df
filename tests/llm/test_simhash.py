"""SimHash classes against brute force over all pairs of fingerprints."""

import os
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import documents, sentence

from tagtrail.llm import simhash
from tagtrail.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """Smallest id reached, from (id, fingerprint); null ids name nothing."""
    f = np.array([x for _, x in rows], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    least = np.array([float("inf") if i is None else i for i, _ in rows])
    while True:
        new = np.array([least[n].min() for n in near])
        if (new == least).all():
            return [None if x == float("inf") else int(x) for x in least]
        least = new


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_table_against_brute_force(spark):
    rows = [(r["doc_id"], slow_fingerprint(r["text"]))
            for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    truth = {i: (f"{f:016x}", c) for (i, f), c in zip(rows, slow_components(rows))}
    got = QUERIES["op11_simhash"](spark, FOLDER).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == truth


@pytest.mark.parametrize("bucket", [1, 2, 5, 64])
@pytest.mark.parametrize("spread", [3, 40])
def test_links_reach_what_all_pairs_reach(spark, bucket, spread):
    rng = random.Random(spread)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(6):  # dense regions, in either half
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randrange(4)):
                x ^= 1 << (rng.randrange(spread) + rng.choice((0, 24)))
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = [(r["src"] % 2 ** 64, r["dst"] % 2 ** 64) for r in simhash.links(df, bucket).collect()]
    assert all((a ^ b).bit_count() <= 2 and a != b for a, b in found)
    name = dict(zip(fps, range(len(fps))))
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in found:
        x, y = sorted((top(name[a]), top(name[b])))
        root[y] = x
    assert [top(i) for i in range(len(fps))] == slow_components(list(enumerate(fps)))


def test_a_third_of_the_rows_in_one_group(spark):
    base = sentence(1, 300).split()
    rows = [(i, sentence(i + 10, 50)) for i in range(40)]
    for i in range(40, 60):
        words = base.copy()
        words[i * 5] = f"other{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, rows[50][1]) for i in range(60, 80)]
    truth = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    for bucket in (2, 64):
        got = {r["doc_id"]: r["component_id"]
               for r in simhash.near_duplicates(documents(spark, rows), bucket).collect()}
        assert [got[i] for i, _ in rows] == truth


def test_odd_rows(spark):
    rows = [(9, None), (4, ""), (6, " \t\n"), (None, ""), (None, "alone and unlike the rest"),
            (3, "Ab  c"), (2, "ab\x0bc"), (2, "something else entirely is here"), (7, "É"), (8, "é"),
            (5, sentence(3, 200_000)), (11, sentence(3, 200_000))]
    got = simhash.near_duplicates(documents(spark, rows, extra="component_id")).collect()
    truth = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    assert sorted(((r["doc_id"], r["fp"] % 2 ** 64, r["component_id"]) for r in got), key=key) == \
        sorted(((i, slow_fingerprint(t), c) for (i, t), c in zip(rows, truth)), key=key)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_long_texts_in_chunks(monkeypatch):
    text = sentence(5, 500)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == slow_fingerprint(text)
    for text in ("a", "a b", "a b c", "A b C d"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)
