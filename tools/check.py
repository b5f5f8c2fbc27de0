"""Run registered queries on Spark and their checks on an ANSI engine and compare the rows.

python tools/check.py [name part ...] with SF_DIR naming the data folder.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketloom.plans import ORACLES, QUERIES
from marketloom.plans.tables import BASE
from marketloom.session import build_session


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("<NA>", "NaT"):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value) if not isinstance(value, (int, bool, str)) else value


def rows_of(records, columns):
    order = sorted(columns)
    return sorted((tuple(plain(r[c]) for c in order) for r in records), key=repr)


def main() -> int:
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = [n for n in QUERIES if not sys.argv[1:] or any(a in n for a in sys.argv[1:])]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    engine = duckdb.connect()
    engine.execute("SET TimeZone='UTC'")
    for name in BASE:
        engine.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = []
    for name in wanted:
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows {name} {len(got)} {took:.1f}s", flush=True)
                continue
            want = engine.execute(ORACLES[name]).fetchdf()
            same_columns = sorted(got.columns) == sorted(want.columns)
            left = rows_of(got.to_dict("records"), got.columns)
            right = rows_of(want.to_dict("records"), want.columns) if same_columns else []
            ok = same_columns and left == right
            types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if same_columns and str(got[c].dtype) != str(want[c].dtype)}
            print(f"{'ok  ' if ok else 'BAD '} {name} {len(got)} {took:.1f}s {types or ''}", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", sorted(got.columns), sorted(want.columns), "rows", len(got), len(want))
                for a, b in [(a, b) for a, b in zip(left, right) if a != b][:3]:
                    print("   spark", a, "\n   sql  ", b)
        except Exception as error:
            bad.append(name)
            print(f"FAIL {name} {str(error)[:900]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
