"""Text, Parquet and JSON files; stage snapshots."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from ..schemas import TAGS


def read_csv(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """Columns by the names in the header, whatever their order; only those of ``schema``. A value
    that isn't of its column's type, or a name that isn't there, ends the job."""
    text = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path)
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def read_tag_log(spark: SparkSession, path: str, schema: StructType = TAGS) -> DataFrame:
    return read_csv(spark, path, schema)


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_csv(spark, path, schema, "\t")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep) \
        .option("encoding", "UTF-8").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    write_csv(df, path, "\t")


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | None = None,
              whole_files: bool = False) -> DataFrame:
    """JSON documents, one on each line; with ``whole_files`` one in each file."""
    reader = spark.read.option("multiLine", whole_files).option("mode", "FAILFAST")
    return (reader if schema is None else reader.schema(schema)).json(path)


def read_json_records(spark: SparkSession, path: str, field: str,
                      schema: StructType | None = None, whole_files: bool = False) -> DataFrame:
    """Records under ``field`` (dots reach into structs) of JSON documents."""
    record = F.explode(F.col(field)).alias("record")
    exploded = read_json(spark, path, schema, whole_files).select(record)
    if isinstance(exploded.schema["record"].dataType, StructType):
        return exploded.select("record.*")
    return exploded


class SnapshotSets:
    """Versions of a set of stage snapshots in a folder. A version counts once its manifest stands in
    the folder, which is put there by one rename after all its snapshots are written. So a reader sees
    all of one version, and a rebuild that fails leaves the version before it in place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(
            spark._jsparkSession.sessionState().newHadoopConf())

    def _manifests(self) -> list[str]:
        top = self._path(self.folder)
        names = [f.getPath().getName() for f in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(n for n in names if re.fullmatch(r"set-[0-9]{9}[.]json", n))

    def current(self) -> dict[str, str] | None:
        """Name to path of the latest version."""
        manifests = self._manifests()
        if not manifests:
            return None
        lines = self.spark.read.text(f"{self.folder}/{manifests[-1]}", wholetext=True)
        return {n: f"{self.folder}/{at}" for n, at in json.loads(lines.first()[0]).items()}

    def read(self) -> dict[str, DataFrame] | None:
        found = self.current()
        return found and {n: read_snapshot(self.spark, at) for n, at in found.items()}

    def write(self, tables: Mapping[str, DataFrame]) -> None:
        """Write a version. Of writers that run at once each has files of its own, and the later
        manifest counts."""
        version = f"set-{uuid.uuid4().hex}"
        places = {name: f"{version}/{name}" for name in tables}
        for name, df in tables.items():
            write_snapshot(df, f"{self.folder}/{places[name]}")
        draft = self._path(f"{self.folder}/{version}/manifest")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(places).encode()))
        out.close()
        while True:
            last = self._manifests()
            number = int(last[-1][4:13]) + 1 if last else 1
            taken = self._path(f"{self.folder}/set-{number:09}.json")
            # Someone else may have taken the number: a rename onto a file that is there fails, or,
            # where a store would replace it, isn't tried.
            if not self._fs.exists(taken) and self._fs.rename(draft, taken):
                return


def load_or_build(spark: SparkSession, folder: str, names: Sequence[str],
                  build: Callable[[], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """The snapshots of the latest version in ``folder`` if it has all ``names``; otherwise build,
    write a version and read it."""
    sets = SnapshotSets(spark, folder)
    found = sets.read()
    if found is None or not set(names) <= set(found):
        built = build()
        sets.write({name: built[name] for name in names})
        found = sets.read()
    return {name: found[name] for name in names}


def register_view(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Name a table for SQL; with ``keep`` hold it in memory and on disk."""
    if keep:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.createOrReplaceTempView(name)
    return df


def small_table(spark: SparkSession, rows: Sequence[tuple] | pd.DataFrame,
                schema: StructType | str) -> DataFrame:
    """A lookup table from local rows, with its schema given."""
    return spark.createDataFrame(rows, schema)


def to_local(df: DataFrame, rows: int) -> pd.DataFrame:
    """A result of at most ``rows`` rows as a local frame; a larger one raises."""
    found = df.limit(rows + 1).toPandas()
    if len(found) > rows:
        raise ValueError(f"the result has more than {rows} rows")
    return found
