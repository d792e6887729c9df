"""Compare named queries with their oracles in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(x):
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return ("f", round(x, 6) + 0.0)
    return (type(x).__name__, x)


def _near(a, b) -> bool:
    return a == b or (isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] == "f"
                      and abs(a[1] - b[1]) <= 1.5e-6)


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(_value(r[n]) for n in names) for r in df.collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_value(r[i]) for i in order)
                                       for r in cur.fetchall()]


def difference(df, con, sql) -> str | None:
    a_names, a = spark_rows(df)
    b_names, b = duck_rows(con, sql)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    left, right = Counter(a), Counter(b)
    if left == right:
        return None
    only_a = sorted((left - right).elements(), key=repr)
    only_b = sorted((right - left).elements(), key=repr)
    return f"{len(only_a)} rows differ, e.g. {only_a[:2]} | {only_b[:2]}"
