"""Compare every registered Spark query with its DuckDB oracle on one scale factor.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, OK/MISMATCH, rows, seconds.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, (float, Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        if f == int(f) and abs(f) < 1e15:
            return str(int(f))
        return repr(round(f, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\x1e".join(lines).encode()).hexdigest()[:16], lines


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def run(sf_dir, names=None, spark=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries
    from lectern.session import build_session
    spark = spark or build_session("local[8]", shuffle_partitions=8)
    qs, os_ = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e)[:300])
            print(name, "SPARK_ERROR", str(e)[:1500], flush=True)
            continue
        ts = time.time() - t0
        if name not in os_:
            results[name] = ("NO_ORACLE", len(srows))
            print(f"{name:28s} NO_ORACLE rows={len(srows)} {ts:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(os_[name])
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("DUCK_ERROR", str(e)[:300])
            print(name, "DUCK_ERROR", str(e)[:2000], flush=True)
            continue
        hs, ls = digest(cols, srows)
        hd, ld = digest(dcols, drows)
        ok = sorted(cols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
        results[name] = ("OK" if ok else "MISMATCH", len(srows))
        print(f"{name:28s} {'OK' if ok else 'MISMATCH'} rows={len(srows)}/{len(drows)} {ts:.1f}s", flush=True)
        if not ok and verbose:
            if sorted(cols) != sorted(dcols):
                print("   cols spark", sorted(cols), "duck", sorted(dcols))
            a, b = set(ls), set(ld)
            for x in sorted(a - b)[:3]:
                print("   spark only:", x[:300])
            for x in sorted(b - a)[:3]:
                print("   duck  only:", x[:300])
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    run(sf, sys.argv[2:] or None)
