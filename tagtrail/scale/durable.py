"""Lineage cuts and scratch tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by the session. Only a local session may go without one."""
    configured = spark.conf.get(CONF, None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CONF} to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tagtrail-"))
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder: later stages, and retries after a lost
    executor, read it back rather than run its history again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a lineage cut whose sizes and
    columns the optimizer knows, and that column pruning works on."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path  # for release
    return table


def buckets(spark: SparkSession) -> int:
    """Into how many buckets ``bucketed`` deals rows: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, name: str = "table", n: int | None = None) -> DataFrame:
    """``df`` as ``stored`` gives it, dealt into ``n`` buckets (``buckets``, if not given) by ``key``: tables
    with the same key join, and group by it, where they lie. Rows that aren't dealt by the key yet should
    be repartitioned by it into as many first, or each task writes a file to every bucket."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n or buckets(spark), key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._scratch, out._named = path, table
    return out


def release(table: DataFrame) -> None:
    """Remove the files of a table from ``stored`` or ``bucketed`` that nothing will read again, such as
    the state of a finished round. Anything else is left alone."""
    path = getattr(table, "_scratch", None)
    if path is None:
        return
    if named := getattr(table, "_named", None):
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {named}")
    jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(session.sessionState().newHadoopConf()).delete(at, True)
    table._scratch = table._named = None
