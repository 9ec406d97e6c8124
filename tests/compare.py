"""Runs a query and its SQL counterpart over the same tables and compares the rows as a multiset."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def normal(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, name, sf_dir, f, sql):
    """(rows, difference as text or '')."""
    df = f(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return sum(ours.values()), ""
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs = rows_of(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return sum(ours.values()), f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        return sum(ours.values()), f"only here {list((ours - theirs).items())[:3]}; only in SQL {list((theirs - ours).items())[:3]}"
    return sum(ours.values()), ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from readloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    for name, f in e.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(a) for a in sys.argv[2:]):
            continue
        began = time.time()
        try:
            n, bad = compare(spark, name, sf, f, e.oracle_sql().get(name))
        except Exception as x:
            n, bad = -1, repr(x)[:1500]
        print(f"{name}: {n} rows, {time.time() - began:.1f} s, {'SQL' if name in e.oracle_sql() else 'rows only'}: {bad or 'ok'}", flush=True)
