"""Small tables for the tests of the pipeline operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows, extra: str = "") -> DataFrame:
    """From (doc_id, text[, lang[, source]]); ``extra`` adds a column of that name."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a",
             len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    return df.selectExpr("*", f"'x' AS {extra}") if extra else df


def sentence(seed: int, n: int = 40) -> str:
    """Words that depend on the seed alone."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2 ** 31
        out.append("".join(chr(97 + (x >> k) % 26) for k in (3, 8, 13, 18)))
    return " ".join(out)
