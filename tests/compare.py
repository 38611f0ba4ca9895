"""Side-by-side run of a catalog query and its SQL."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def oracle(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


SPARK_KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "date": "DATE"}


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when columns, types and all rows agree."""
    got_cols = spark_df.columns
    got = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns {sorted(got_cols)} != {sorted(want_cols)}"]
    out = []
    for name, kind in spark_df.dtypes:
        if SPARK_KIND.get(kind, kind) != want_types[name]:
            out.append(f"type of {name}: {kind} vs {want_types[name]}")
    a, b = _rows(got_cols, got), _rows(want_cols, want)
    if len(a) != len(b):
        out.append(f"{len(a)} rows vs {len(b)}")
    if a != b:
        from collections import Counter
        ca, cb = Counter(map(repr, a)), Counter(map(repr, b))
        only_a, only_b = list((ca - cb).elements()), list((cb - ca).elements())
        if only_a or only_b:
            out.append(f"{len(only_a)} only in Spark e.g. {only_a[:2]}; {len(only_b)} only in SQL e.g. {only_b[:2]}")
    if not a:
        out.append("no rows")
    return out
