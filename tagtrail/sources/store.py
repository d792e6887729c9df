"""Document tables: replace whole, look up by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_documents(docs: DataFrame, path: str) -> None:
    """Drop what the table held and write ``docs``."""
    docs.write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find_document(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The document with that ``_id``, or no row; the key is pushed down to the scan."""
    return read_documents(spark, path).filter(F.col("_id") == key)
