"""Local correctness gate: run each registered query on Spark and its SQL oracle
on DuckDB over the same parquet tables, compare rows, columns and values.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from logweave.plans import all_queries  # noqa: E402
from logweave.session import get_session  # noqa: E402
from logweave.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None or v is getattr(__import__("pandas"), "NA", None):
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v == int(v) and abs(v) < 2**53 else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(repr(norm(x)) for x in rec))
    return cols, sorted(out)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    qs, oracles = all_queries()
    spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracles:
            print(f"{name:28s} rows-only  rows={len(sp)}  spark={ts:.1f}s")
            continue
        t1 = time.time()
        try:
            dd = con.execute(oracles[name]).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SQL-ERROR {str(e)[:600]}")
            bad += 1
            continue
        td = time.time() - t1
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(dd)
        ok = c1 == c2 and r1 == r2
        status = "OK " if ok else "MISMATCH"
        print(f"{name:28s} {status} rows={len(r1)}/{len(r2)} spark={ts:.1f}s duck={td:.1f}s")
        if not ok:
            bad += 1
            if c1 != c2:
                print("   cols", c1, c2)
            else:
                s1, s2 = set(r1), set(r2)
                for r in list(s1 - s2)[:3]:
                    print("   spark-only", str(r)[:300])
                for r in list(s2 - s1)[:3]:
                    print("   duck-only ", str(r)[:300])
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
