"""Compare every query with its check SQL: python tests/check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import signal
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 6)
    if type(v).__name__ in ("Timestamp", "datetime"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


TIMES = {}


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    """None when equal, else a short description of the difference."""
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - t
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    want = rows_of(cols, cur.fetchall())
    if got != want:
        a, b = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} vs {sum(want.values())} rows; only spark {a}; only duckdb {b}"
    return None if sum(got.values()) else "no rows"


def _too_slow(*_):
    raise TimeoutError("query took too long")


def main():
    from tests.conftest import make_session

    from lurewatch.plans import registry_jobs  # noqa: F401
    from lurewatch.plans.registry import ORACLE, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = make_session(), connect(sf_dir), 0
    limit = int(os.environ.get("QUERY_SECONDS", "90"))
    signal.signal(signal.SIGALRM, _too_slow)
    for name in names:
        t = time.time()
        signal.alarm(limit)
        try:
            if name in ORACLE:
                msg = compare(spark, con, sf_dir, name, QUERIES[name], ORACLE[name])
            else:
                msg = None if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as e:  # report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        signal.alarm(0)
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t:.1f}s spark {TIMES.get('spark', 0):.1f}s {msg or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
