"""Compare registered queries with their SQL checks.

    python check.py [--sf DIR] [names or prefixes ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import time
import traceback

import duckdb

from foliospark.plans import registry
from foliospark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"float:{value!r}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return f"{type(value).__name__}:{value}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([str([plain(r[i]) for i in order]) for r in rows])


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    if name not in registry.CHECKS:
        return "rows", len(got), seconds, ""
    cur = con.execute(registry.CHECKS[name])
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return "COLUMNS", len(got), seconds, f"{sorted(df.columns)} != {sorted(want_names)}"
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a == b:
        return ("ok" if a else "EMPTY"), len(got), seconds, ""
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return "DIFF", len(got), seconds, f"{len(a)} vs {len(b)}\n   spark {only_a}\n   sql   {only_b}"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    registry.load_all()
    spark, con = local_session(), duck(args.sf)
    bad = 0
    for name in registry.QUERIES:
        if args.names and not any(name == n or name.startswith(n) for n in args.names):
            continue
        try:
            status, n, seconds, detail = compare(spark, con, name, args.sf)
        except Exception as exc:
            status, n, seconds, detail = "ERROR", 0, 0.0, f"{type(exc).__name__}: {str(exc)[:1500]}"
            if not isinstance(exc, duckdb.Error) and "pyspark" not in type(exc).__module__:
                detail += traceback.format_exc()[-1500:]
        bad += status not in ("ok", "rows")
        print(f"{status:8} {name:28} {n:7} {seconds:6.2f}s {detail}", flush=True)
    print("not ok:", bad)


if __name__ == "__main__":
    main()
