"""Run registered queries next to their SQL twins: python -m tests.oracle_harness [sf_dir] [name part ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_cell(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got_names = df.columns
    got = normal([tuple(r) for r in df.collect()], got_names)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), names)
    if sorted(names) != sorted(got_names):
        return len(got), f"columns {sorted(got_names)} != {sorted(names)}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return len(got), f"first difference: {a} != {b} (columns {sorted(names)})"
    return len(got), None


def main() -> int:
    from tests.conftest import make_session
    import __spark_entry__ as entry
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = make_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            rows, problem = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        took = time.time() - t
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:48s} rows={rows} {took:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
