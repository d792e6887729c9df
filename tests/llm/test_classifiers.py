"""Quality, toxicity and language: held-out accuracy, odd rows, repeatability."""

import os

import numpy as np
import pytest
from helpers import documents, sentence
from pyspark.sql import functions as F

from tagtrail.llm import language, quality, toxicity
from tagtrail.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 300_000), (4, "x" * 300_000), (None, "abc def"),
       (5, "\U0001F600 İß")]


@needs_tables
def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = QUERIES["op1_quality"](spark, FOLDER).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got["quality"] == 1], got[got["quality"] == 0]
    assert (good["predicted"] == 1).mean() >= 0.98
    assert (bad["predicted"] == 0).mean() >= 0.85
    assert got["score"].between(0, 1).all()


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = QUERIES["op6_toxicity"](spark, FOLDER).join(labels, "doc_id").where("held_out").toPandas()
    toxic, other = got[got["toxic"] == 1], got[got["toxic"] == 0]
    assert (other["predicted"] == 0).mean() >= 0.99
    assert (toxic["predicted"] == 1).mean() >= 0.5


@needs_tables
def test_language_on_held_out_rows(spark):
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op3_language"](spark, FOLDER).join(truth, "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.99


def learning_tables(spark, n=40):
    rows = [(i, ("nice calm words " if i % 2 else "you rotten scoundrel ") + sentence(i))
            for i in range(n)]
    labels = spark.createDataFrame(
        [(i, i % 2, 1 - i % 2) for i in range(n)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (999, 1, 1),
                                                      (1, None, None), (3, 7, 7), (5, 1, 0)],
        "doc_id long, quality int, toxic int")
    return documents(spark, rows, extra="y"), labels


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_learns_and_takes_odd_rows(spark, module, label):
    docs, labels = learning_tables(spark)
    model = module.train(docs, labels, F.lit(True))
    again = module.train(docs.repartition(7), labels, F.lit(True))
    assert np.array_equal(model.weights, again.weights)
    odd = documents(spark, ODD, extra="score_")
    got = module.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["text"], set()).add(r["score"])
    assert by[None] == by[""] and all(len(s) == 1 for s in by.values())
    seen = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    high = [seen[i] for i in range(5, 40) if (i % 2) == (label == "quality")]
    low = [seen[i] for i in range(5, 40) if (i % 2) != (label == "quality")]
    assert min(high) > max(low)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_without_rows(spark, module):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.train(docs, labels, F.lit(True))
    assert module.score(docs, model).count() == 0
    got = [r["score"] for r in module.score(documents(spark, [(1, "a b")]), model).collect()]
    assert got == ([0.5] if module is quality else [pytest.approx(0, abs=1e-9)])


def test_toxic_grams_against_slow_form():
    def slow(text):
        t = "".join(c if c.isalnum() else " " for c in text.lower())
        return " " + " ".join(t.split()) + " "
    a, b = "Some  TEXT, with\n3 gaps!", "some text with 3 gaps"
    assert slow(a) == slow(b)
    grams = toxicity.Grams()
    assert np.array_equal(grams(a), grams(b)) and len(grams(a)) == len(grams(a))
    distinct = {slow(a)[i:i + n] for n in (3, 4, 5) for i in range(len(slow(a)) - n + 1)}
    assert len(grams(a)) <= len(distinct) and len(grams(a)) >= 0.95 * len(distinct)


def slow_profile(text, n=300):
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    counts = {}
    for word in t.split():
        padded = "\0" + word + "\0"
        for k in (1, 2, 3):
            for i in range(len(padded) - k + 1):
                g = padded[i:i + k]
                if g != "\0":
                    counts[g] = counts.get(g, 0) + 1
    packed = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) + (
        1 << 63 if len(g) == 2 else 0)
    return sorted((packed(g) for g in counts), key=lambda p: (
        -{packed(g): c for g, c in counts.items()}[p], p))[:n]


def test_language_profile_against_slow_form():
    text = "The cat, the hat; Über-Größe 12 élan " * 3
    assert language.profile(*language.gram_counts(text)).tolist() == slow_profile(text)


def test_language_takes_odd_rows(spark):
    docs = documents(spark, [(i, f"the house and the {sentence(i, 3)} of the", "en")
                             for i in range(20)]
                     + [(100 + i, f"das haus und der {sentence(i, 3)} von dem", "de")
                        for i in range(20)]
                     + [(200, "nothing known", None), (None, "le chat", "fr"), (201, None, "fr")],
                     extra="found")
    profiles = language.train(docs, F.lit(True))
    assert sorted(profiles) == ["de", "en"]
    odd = documents(spark, [(1, None), (2, ""), (3, "12 34 ,.!"), (4, "the house of the cat"),
                            (5, "das haus von dem hund"), (5, "das haus von dem hund"),
                            (6, "the and " * 50_000)], extra="lang_")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(odd, profiles).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de"), (6, "en")]
    nothing = language.train(documents(spark, []), F.lit(True))
    assert nothing == {}
    assert [r["lang_pred"] for r in language.identify(odd, nothing).collect()] == ["und"] * 7


def test_ratios_send_a_row_per_slice_of_places_to_the_driver(spark, monkeypatch):
    texts = [("abc def", 1), ("abc", 1), ("xyz", 0), ("def ghi", 0), (None, 0), ("abc", 0)]
    sample = spark.createDataFrame(texts, "text string, y int").repartition(3)
    brought, kind = [], type(sample)
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(kind, name, lambda self, do=getattr(kind, name): (
            out := do(self), brought.append(len(out)))[0])
    ratios = toxicity._ratios(sample)
    assert sum(brought) <= toxicity.PLACES // toxicity._SLICE + 1
    grams, seen = toxicity.Grams(), np.zeros((2, toxicity.PLACES))
    for text, y in texts:
        seen[y][grams(text)] += 1
    assert np.array_equal(ratios, np.log((seen[1] + 1) / (2 + 2) / ((seen[0] + 1) / (4 + 2))))
