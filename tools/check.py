"""Run registered queries next to their SQL oracles and compare.

    python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from framepair.catalog import ORACLES, QUERIES
from framepair.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def text(v) -> str:
    if v is None or v != v:
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 9))
    return str(v)


def canonical(rows, columns):
    """Rows as sorted text with columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def kinds(rows, columns):
    """Python value types seen in each column."""
    return {c: {type(r[i]).__name__ for r in rows} - {"NoneType"} for i, c in enumerate(columns)}


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = []
    for name in args.names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            found = [tuple(r) for r in df.collect()]
            got, cols = canonical(found, df.columns)
        except Exception as e:  # noqa: BLE001 - report and go on
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:1500]}")
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s {got[:1]}")
            continue
        start = time.time()
        try:
            cur = con.execute(ORACLES[name])
            ocols = [d[0] for d in cur.description]
            wanted = cur.fetchall()
            want, wcols = canonical(wanted, ocols)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"SQL   {name}: {str(e)[:1500]}")
            continue
        same = got == want and cols == wcols
        a, b = kinds(found, df.columns), kinds(wanted, ocols)
        odd = {c: (a[c], b.get(c)) for c in a if a[c] != b.get(c)}
        if odd:
            print(f"types {name}: {odd}")
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(got)}/{len(want)} rows {took:.1f}s sql {time.time() - start:.1f}s", flush=True)
        if not same:
            bad.append(name)
            print("   columns", cols, wcols)
            x, y = set(got), set(want)
            print("   only spark", sorted(x - y)[:4], "\n   only sql  ", sorted(y - x)[:4], len(x - y), len(y - x))
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
