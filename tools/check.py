"""Order-insensitive comparison of a Spark result with an SQL oracle result:
row count, column names, and a hash of the rows (columns sorted by name,
doubles at 6 decimals)."""

from __future__ import annotations

import hashlib
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if v is None:
        return "None"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12], lines


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql: str):
    """(same, spark_rows, oracle_rows, spark_only, oracle_only)."""
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    hs, ls = digest(df.columns, srows)
    hd, ld = digest(dcols, drows)
    same = len(srows) == len(drows) and sorted(df.columns) == sorted(dcols) and hs == hd
    a, b = set(ls), set(ld)
    return same, len(srows), len(drows), sorted(a - b)[:3], sorted(b - a)[:3]
