"""Local stand-in for the driver's correctness gate: run a registered Spark
query and its DuckDB oracle on the same parquet tables and compare rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


_SPARK_TO_DUCK = {"double": "DOUBLE", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return (v, math.copysign(1.0, v))   # -0.0 and 0.0 hash differently
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    con = duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols), f"{name}: columns {sorted(scols)} != {sorted(dcols)}"
    stypes = {f.name: _SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    dtypes = {d[0]: str(d[1]) for d in res.description}
    bad_t = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
    assert not bad_t, f"{name}: column types differ (spark, duckdb): {bad_t}"
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    assert len(a) == len(b), f"{name}: {len(a)} rows vs oracle {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, f"{name}: {len(bad)} differing rows, first {bad[:2]}"
    return len(a)
