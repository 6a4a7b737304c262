"""Run registered queries beside their SQL and compare the results.

usage: python checks.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

from tallyboard.plans import load
from tallyboard.session import get_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def main(argv: list[str]) -> int:
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    queries, oracles = load()
    spark = get_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{Path(sf)}/{t}.parquet'")
    bad = []
    for name, fn in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        began = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - began
            if name not in oracles:
                print(f"rows {name}: {len(rows)} in {took:.2f}s", flush=True)
                continue
            cur = con.execute(oracles[name])
            names = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]) for d in cur.description}
            want = canonical(names, cur.fetchall())
            got = canonical(df.columns, rows)
            ints = [n for n, k in kinds.items() if "HUGEINT" in k or "DECIMAL" in k]
            if got == want and not ints:
                note = "" if rows else "  EMPTY"
                print(f"ok   {name}: {len(rows)} in {took:.2f}s{note}", flush=True)
                continue
            bad.append(name)
            print(f"FAIL {name}: {len(rows)} vs {len(want[1])} rows; wide {ints}")
            if got[0] != want[0]:
                print("   columns", set(got[0]) ^ set(want[0]))
            a = [r for r in got[1] if r not in set(want[1])] if len(got[1]) < 30000 else []
            b = [r for r in want[1] if r not in set(got[1])] if len(got[1]) < 30000 else []
            print("   cols ", got[0])
            print("   spark", a[:3])
            print("   sql  ", b[:3], flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print("bad:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
