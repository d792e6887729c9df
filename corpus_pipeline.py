"""A corpus from raw documents: toxicity, line dedup, Jaccard join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame, which
is written as Parquet and read back as the next stage's ``docs``. All but the last return the columns
of ``documents``; the last returns the mix: one row per document with its copies and its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrail.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from tagtrail.llm.stream import small_batches
from tagtrail.scale.durable import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.lit(True))
    return toxicity.score(docs, model, to="_toxic").where(F.col("_toxic") < toxicity.CUT) \
        .select(*docs.columns)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks that an earlier document has; emptied documents go."""
    small_batches(spark)
    return line_dedup.dedup_lines(docs, keep_empty=False) \
        .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        .select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of similar ones."""
    small_batches(spark)
    return jaccard_join.near_distinct(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    small_batches(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document stands in the mix, and where."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", delete_repeated_lines),
    ("jaccard_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: No SQL for a trained classifier, common runs of lines or sampled paths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
