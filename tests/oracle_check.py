"""Run registered Spark queries next to their DuckDB oracles and compare results.

Usage: ``python tests/oracle_check.py [sf_dir] [query ...]``. Also used by
``tests/test_oracles.py``. Compares row count, column names and the multiset of
rows (doubles rounded to 6 places), the way the driver's check does.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rep = {"query": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        rep["oracle"] = "none"
        return rep
    con = con or duck(sf_dir)
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = [tuple(r) for r in res.fetchall()]
    rep["oracle_rows"] = len(o_rows)
    rep["columns_match"] = sorted(s_cols) == sorted(o_cols)
    a, b = rows_of(s_cols, s_rows), rows_of(o_cols, o_rows)
    rep["match"] = rep["columns_match"] and a == b
    if not rep["match"]:
        rep["spark_cols"], rep["oracle_cols"] = s_cols, o_cols
        sa, sb = set(a), set(b)
        rep["only_spark"] = sorted(sa - sb, key=str)[:5]
        rep["only_oracle"] = sorted(sb - sa, key=str)[:5]
    return rep


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from txnclean.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(queries())
    spark = local_session(8, checkpoint_dir="/tmp/txnclean-checkpoints")
    qs, os_ = queries(), oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            rep = compare(spark, sf_dir, n, qs[n], os_.get(n), con)
        except Exception as e:  # report and go on
            rep = {"query": n, "error": repr(e)[:400]}
        ok = rep.get("match", rep.get("oracle") == "none")
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(rep), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
