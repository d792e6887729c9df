"""Batches of texts for Python workers, and sorted groups as a stream over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a worker holds at a time; texts are larger than what Spark's default is meant for.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python workers in batches of ``BATCH_ROWS`` at most."""
    now = int(spark.conf.get(BATCH))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def sorted_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str],
                  most: int | None = None) -> Iterator[pd.DataFrame]:
    """Groups of equal ``keys`` from frames sorted by them; a group may span frames. With ``most``
    a larger group comes in pieces of that many rows."""
    for group in _whole_groups(frames, keys, most):
        for start in range(0, len(group), most or len(group)):
            yield group.iloc[start:start + most] if most else group


def _whole_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str],
                  most: int | None) -> Iterator[pd.DataFrame]:
    keys = list(keys)
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if frame.empty:
            continue
        changed = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        changed[0] = last is not None and tuple(frame[keys].iloc[0]) != last
        cuts = [0, *changed.nonzero()[0].tolist(), len(frame)]
        for start, end in zip(cuts, cuts[1:]):
            if start and held or start == 0 and changed[0] and held:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            if end > start:
                held.append(frame.iloc[start:end])
            if most and sum(map(len, held)) >= most:
                whole = pd.concat(held, ignore_index=True)
                full = len(whole) - len(whole) % most
                yield whole.iloc[:full]
                held = [whole.iloc[full:]] if full < len(whole) else []
        last = tuple(frame[keys].iloc[-1])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def map_groups(df: DataFrame, keys: Sequence[str],
               each: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str,
               order: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """``each`` on every group of ``keys``, or on pieces of ``most`` rows of it; many small groups
    cost one stream, not one call into Spark each. Keys must not be null."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        rows = 0
        for group in sorted_groups(frames, keys, most):
            made = each(group)
            if made is not None and len(made):
                out.append(made)
                rows += len(made)
            if rows >= 2000:
                yield pd.concat(out, ignore_index=True)
                out, rows = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return dealt.mapInPandas(step, schema)
