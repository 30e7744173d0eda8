"""Side-by-side run of a registered query and its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, path, fn, sql, con=None):
    """None if equal, else a description of the first difference."""
    con = con or connect(path)
    df = fn(spark, path)
    s_names, s_rows = sorted_rows([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_kinds = {c[0]: str(c[1]) for c in res.description}
    d_names, d_rows = sorted_rows(res.fetchall(), d_cols)
    if s_names != d_names:
        return f"columns {s_names} / {d_names}"
    kinds = {n: KINDS.get(t, t) for n, t in df.dtypes}
    wrong = {n: (kinds[n], d_kinds[n]) for n in s_names if kinds[n] != d_kinds[n]}
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} / {len(d_rows)}"
    if s_rows != d_rows:
        bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
        cut = [tuple(str(x)[:300] for x in p) for p in bad[:3]]
        return f"{len(bad)} of {len(s_rows)} rows differ, {s_names}: {cut}"
    if wrong:
        return f"types {wrong}"
    return None


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tidemark.session import local_session

    spark = local_session()
    path, only = sys.argv[1], sys.argv[2:]
    con = connect(path)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            if name in sql:
                verdict = compare(spark, path, fn, sql[name], con) or "ok"
            else:
                verdict = f"rows only: {len(fn(spark, path).collect())}"
        except Exception as e:
            verdict = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += not (verdict == "ok" or verdict.startswith("rows only"))
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failed:", bad)
