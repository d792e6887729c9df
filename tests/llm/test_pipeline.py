"""The pipeline's stages one by one, and the guard around the subpackage."""

import os
import subprocess
import sys

import pytest
from helpers import documents, sentence

FOLDER = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@needs_tables
def test_stages(spark):
    import corpus_pipeline as c
    from tagtrail.llm import decontamination, jaccard_join

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination",
                                       "mixing"]
    seen = {}
    for name, stage in c.STAGES:
        before, docs = docs, c.stored(stage(spark, docs, FOLDER), name)
        seen[name] = docs
        if name != "mixing":
            assert docs.columns == before.columns
            old = {r["doc_id"] for r in before.select("doc_id").collect()}
            new = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert len(set(new)) == len(new) and set(new) <= old
            if name == "toxicity":
                gone = old - set(new)
                assert gone and not any(labels.get(i) == 0 for i in gone)
    assert seen["line_dedup"].where("n_chars != length(text) OR text = ''").isEmpty()
    assert jaccard_join.similar_classes(seen["jaccard_join"]).where("class_id != doc_id").isEmpty()
    assert decontamination.find_overlaps(seen["decontamination"], benchmark).isEmpty()
    mixed = seen["mixing"].toPandas()
    assert sorted(mixed["doc_id"]) == sorted(
        r["doc_id"] for r in seen["decontamination"].select("doc_id").collect())


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline as c

    text = "\n".join(sentence(i, 12) for i in range(4))
    rows = [(1, None), (2, ""), (3, text), (4, text), (None, sentence(77)), (5, sentence(9) + "x"),
            (5, sentence(9) + "x"), (6, "w " * 50_000, "en", None)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int") \
        .write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (documents(spark, rows), documents(spark, [])):
        empty = docs.isEmpty()
        for name, stage in c.STAGES:
            docs = c.stored(stage(spark, docs, str(tmp_path)), name)
        if empty:
            assert docs.isEmpty()
        else:  # the copy of a text goes, all else stays
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 2, 3, 5, 5, 6]


def test_library_without_the_subpackage():
    code = ("import sys\nsys.modules['tagtrail.llm'] = None\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.split('.')[:2] == ['tagtrail', 'llm']:\n"
            "            raise ModuleNotFoundError('gone', name='tagtrail.llm')\n"
            "del sys.modules['tagtrail.llm']\nsys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert e.queries() and not any(q.startswith('op1_') for q in e.queries())\n"
            "assert 'pipeline' not in e.queries()\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
