"""Runs queries beside their SQL, as the driver does: python tests/compare.py SF_DIR NAME..."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import duckdb

import __spark_entry__ as e


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x) if x is not None and not isinstance(x, (int, bool, str)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else p
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{src}'")
    return c


def recomputations():
    """Checks of queries that SQL can't express: (connection, rows) -> (fine, note)."""
    import recompute

    found = dict(recompute.CHECKS)
    try:
        from llm import recompute as more
    except ImportError:
        return found
    return {**found, **more.CHECKS}


def compare(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    began = time.time()
    df = e.queries()[name](spark, sf_dir)
    data = df.collect()
    got = rows(df.columns, data)
    took = time.time() - began
    sql = e.oracle_sql().get(name)
    if sql is None:
        check = recomputations().get(name)
        if check is None:
            return False, f"{name}: neither SQL nor a re-computation"
        ok, note = check(connect(sf_dir), [dict(zip(df.columns, r)) for r in data])
        return ok, f"{name}: {note}, {len(got)} rows, {took:.1f} s"
    rel = connect(sf_dir).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    same = sorted(df.columns) == sorted(rel.columns) and got == want
    note = ""
    if not same:
        a, b = set(map(repr, got)), set(map(repr, want))
        note = f"\n  columns {sorted(df.columns)} {sorted(rel.columns)}\n  only Spark {len(a - b)}: {sorted(a - b)[:3]}\n  only SQL {len(b - a)}: {sorted(b - a)[:3]}"
    return same, f"{name}: {'same' if same else 'DIFFERENT'}, {len(got)} and {len(want)} rows, {took:.1f} s{note}"


if __name__ == "__main__":
    from sparkmoment.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(e.queries())
    bad = 0
    for n in names:
        try:
            ok, said = compare(spark, sys.argv[1], n)
        except Exception as x:  # noqa: BLE001
            ok, said = False, f"{n}: ERROR {str(x)[:900]}"
        bad += not ok
        print(said, flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
