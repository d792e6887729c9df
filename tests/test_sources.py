"""Files, dumps, document tables, snapshots, skew helpers and lineage cuts."""

import json

import pytest
from pyspark.sql import functions as F

from tagtrail.scale import durable, skew
from tagtrail.sources import dumps, files, store


def dump(folder, pages):
    """Two pages to a file, one on each line."""
    folder.mkdir()
    for i in range(0, len(pages), 2):
        (folder / f"pages{i}.json").write_text("\n".join(map(json.dumps, pages[i:i + 2])))
    return str(folder)


def test_tag_log_roundtrip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 0, "a,b", 5, 100), (2, 1, None, None, 200)],
                               "id long, tool_id long, bundle_id string, "
                               "refers_to_object_id long, created long")
    files.write_csv(df, str(tmp_path / "csv"))
    assert rows(files.read_tag_log(spark, str(tmp_path / "csv"))) == rows(df)
    files.write_tsv(df, str(tmp_path / "tsv"))
    assert rows(files.read_tsv(spark, str(tmp_path / "tsv"), df.schema)) == rows(df)
    files.write_csv(df.select("created", "bundle_id", F.lit(3).alias("more"), "tool_id",
                              "refers_to_object_id", "id"), str(tmp_path / "other"))
    assert rows(files.read_tag_log(spark, str(tmp_path / "other"))) == rows(df)


def test_pages(spark, tmp_path, rows):
    folder = dump(tmp_path / "objects", [
        {"stat": "ok", "total": "3", "pages": 2, "objects": [{"id": "1"}, {"id": "2"}]},
        {"stat": "ok", "total": "3", "pages": 2, "objects": [{"id": "3"}]}])
    assert rows(dumps.site_objects(spark, folder).select("id")) == [(1,), (2,), (3,)]
    assert dumps.page_completeness(spark, folder, "objects").first().asDict() == \
        {"found": 3, "total": 3, "complete": True}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "page.json").write_text(json.dumps(
        {"total": 1, "objects": [{"id": "9"}]}, indent=4))
    assert rows(dumps.site_objects(spark, str(tmp_path / "one"), whole_files=True).select("id")) \
        == [(9,)]
    short = dump(tmp_path / "short", [{"total": 5, "objects": [{"id": "1"}]}])
    assert not dumps.page_completeness(spark, short, "objects").first()["complete"]


def test_site_lists(spark, tmp_path, rows):
    site = dump(tmp_path / "site", [{"sites": {"site": [
        {"id": "7", "name": "m", "count_objects": 1, "count_rooms": 2, "count_spots": 3, "x": 0},
        {"id": "8", "name": "n", "count_objects": 1, "count_rooms": 2, "count_spots": 3, "x": 0}]
    }}])
    assert dumps.site_summary(spark, site).first().asDict() == {
        "id": "7", "name": "m", "count_objects": 1, "count_rooms": 2, "count_spots": 3}
    rooms = dump(tmp_path / "rooms", [{"total": 1, "rooms": {"room": [
        {"id": "1", "name": "201", "floor": 2, "count_objects": "5", "count_spots": "4",
         "other": 1}]}}])
    assert rows(dumps.site_rooms(spark, rooms)) == [("1", "201", 2, 5, 4)]
    spots = dump(tmp_path / "spots", [{"total": 1, "spots": {"spot": [{"id": "1", "name": "s"}]}}])
    assert rows(dumps.site_spots(spark, spots).select("id", "name")) == [("1", "s")]
    for name, read in (("departments", dumps.site_departments), ("types", dumps.site_types)):
        folder = dump(tmp_path / name, [{name: [{"id": "1", "name": "x"}]}, {name: []},
                                        {"total": 0}])
        assert rows(read(spark, folder)) == [("1", "x")]
    shown = dump(tmp_path / "exhibitions", [{"exhibitions": [
        {"id": 5, "title": "t", "date_start": "2016-01-01", "date_end": "2016-02-01", "more": 1}]}])
    assert rows(dumps.site_exhibitions(spark, shown)) == [("5", "t", "2016-01-01", "2016-02-01")]


def test_exhibition_documents(spark, tmp_path, rows):
    folder = dump(tmp_path / "shows", [
        {"exhibition_id": 1, "objects": [{"id": "5"}]}, {"exhibition_id": 2, "objects": []},
        {"exhibition_id": 1, "objects": [{"id": "6"}]}])
    docs = dumps.exhibition_documents(spark, folder)
    path = str(tmp_path / "docs")
    store.replace_documents(docs, path)
    store.replace_documents(docs, path)
    assert store.read_documents(spark, path).count() == 2
    assert store.find_document(spark, path, "1").count() == 2
    assert store.find_document(spark, path, "2").count() == 0


def test_json_sink(spark, tmp_path, rows):
    path = str(tmp_path / "j")
    df = spark.createDataFrame([([(1, "a"), (2, "b")],)],
                               "records array<struct<id:long,name:string>>")
    files.write_json(df.coalesce(1), path)
    assert rows(files.read_json_records(spark, path, "records")) == [(1, "a"), (2, "b")]


def test_load_or_build(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return {"a": spark.range(3), "b": spark.range(4)}

    for _ in range(2):
        got = files.load_or_build(spark, str(tmp_path / "s"), ["a", "b"], build)
        assert {k: d.count() for k, d in got.items()} == {"a": 3, "b": 4}
    assert calls == [1]
    # A name that the version lacks needs a new one.
    got = files.load_or_build(spark, str(tmp_path / "s"), ["c"], lambda: {"c": spark.range(2)})
    assert got["c"].count() == 2


def test_a_failed_rebuild_leaves_the_set_before_it(spark, tmp_path):
    sets = files.SnapshotSets(spark, str(tmp_path / "s"))
    assert sets.current() is None and sets.read() is None
    sets.write({"a": spark.range(3), "b": spark.range(4)})
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sets.write({"a": spark.range(30), "b": broken})
    assert {n: d.count() for n, d in sets.read().items()} == {"a": 3, "b": 4}
    # Tables that were read stay readable while a new version comes.
    held = sets.read()
    sets.write({"a": held["a"].union(spark.range(2)), "b": spark.range(1)})
    assert held["a"].count() == 3
    assert {n: d.count() for n, d in sets.read().items()} == {"a": 5, "b": 1}


def test_two_writers_take_two_numbers(spark, tmp_path, monkeypatch):
    sets = files.SnapshotSets(spark, str(tmp_path / "s"))
    sets.write({"a": spark.range(1)})
    seen = sets._manifests()
    sets.write({"a": spark.range(2)})
    stale = iter([seen])  # what the other writer saw before
    plain = files.SnapshotSets._manifests
    monkeypatch.setattr(files.SnapshotSets, "_manifests", lambda self: next(stale, None) or plain(self))
    sets.write({"a": spark.range(3)})
    assert len(sets._manifests()) == 3 and sets.read()["a"].count() == 3


def test_views_and_small_tables(spark):
    df = files.register_view(files.small_table(spark, [(1, "x")], "id int, n string"), "small",
                             keep=True)
    assert spark.table("small").count() == 1 and df.storageLevel.useMemory
    df.unpersist()
    assert len(files.to_local(spark.range(7), 7)) == 7
    with pytest.raises(ValueError):
        files.to_local(spark.range(8), 7)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.usefixtures("joins")
def test_lookup_join_equals_a_plain_join(spark, rows, how):
    big = spark.range(200).select(
        "id", F.when(F.col("id") < 70, F.lit(1)).when(F.col("id") % 9 == 0, None)
        .otherwise(F.col("id") % 5).alias("k"))
    lookup = spark.createDataFrame([(1, "one"), (2, "two"), (8, "eight"), (None, "null")],
                                   "k long, name string")
    plain = rows(big.join(lookup, ["k"], how))
    assert rows(skew.lookup_join(big, lookup, ["k"], how), *big.join(lookup, ["k"], how).columns) \
        == plain


def test_hot_keys_are_split(spark, joins):
    """Twenty keys hold most rows; none is singled out by the code."""
    big = spark.range(0, 60_000, 1, 16).select(
        "id", F.when(F.col("id") % 4 > 0, F.col("id") % 4 * 100).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.lookup_join(big, lookup, ["k"])
    assert len(got.collect()) == 60_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("skew=true" in plan) == (joins == "shuffle")
    assert got.where("v <> 2 * k OR v IS NULL").isEmpty()


def test_cut_uses_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert durable.checkpoint_dir(spark) == folder
    assert durable.scratch_path(spark, "x").startswith(folder)
    cut = durable.cut(spark.range(5).withColumn("x", F.col("id") * 2))
    assert cut.count() == 5
    assert "Scan ExistingRDD" in cut._jdf.queryExecution().toString()
