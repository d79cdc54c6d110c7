"""Compare a registered Spark query with its DuckDB oracle (dev + tests)."""

from __future__ import annotations

import math

from ..sources.tables import TABLES


def duckdb_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(list(v))
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def compare(spark, con, query, sf_dir: str, show: int = 5) -> dict:
    sdf = query.spark_fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    out = {"name": query.name, "spark_rows": len(s_rows), "cols": s_cols}
    if query.sql_fn is None:
        out["status"] = "rows-only"
        return out
    rel = con.execute(query.sql_fn())
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    out["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"schema mismatch spark={sorted(s_cols)} duck={sorted(d_cols)}"
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_idx = {c: i for i, c in enumerate(d_cols)}
    sk = sorted(tuple(_norm(r[i]) for i in order) for r in s_rows)
    dk = sorted(tuple(_norm(r[d_idx[s_cols[i]]]) for i in order) for r in d_rows)
    if sk == dk:
        out["status"] = "match"
    else:
        diff_s = [r for r in sk if r not in set(dk)][:show]
        diff_d = [r for r in dk if r not in set(sk)][:show]
        out["status"] = "value mismatch"
        out["only_spark"] = diff_s
        out["only_duck"] = diff_d
        out["cols_sorted"] = [s_cols[i] for i in order]
    return out
