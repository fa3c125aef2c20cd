"""Compare registered queries with their DuckDB twins: python tools/check.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from shelfspark.plans.registry import oracle_sql, queries  # noqa: E402
from shelfspark.plans.views import TABLES  # noqa: E402
from shelfspark.session import local_session  # noqa: E402


def norm(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        if math.isnan(value):
            return "~"
        return repr(value)
    return str(value)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = local_session("check")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = sorted(df.columns)
            got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
        except Exception as exc:  # report and go on with the next query
            print(f"FAIL {name}: spark {type(exc).__name__}: {str(exc)[:700]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s")
            bad += not got
            continue
        try:
            res = con.execute(oracles[name])
            names = [d[0] for d in res.description]
            types = {d[0]: str(d[1]) for d in res.description}
            pos = [names.index(c) for c in sorted(names)]
            exp = sorted(tuple(norm(r[i]) for i in pos) for r in res.fetchall())
        except Exception as exc:
            print(f"FAIL {name}: duckdb {str(exc)[:700]}")
            bad += 1
            continue
        odd = [
            (c, t, dict(df.dtypes).get(c)) for c, t in types.items()
            if {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}.get(t)
            != dict(df.dtypes).get(c)
        ]
        if sorted(names) != cols:
            print(f"FAIL {name}: columns {cols} vs {sorted(names)}")
            bad += 1
        elif got != exp:
            a, b = set(got), set(exp)
            print(f"FAIL {name}: {len(got)} vs {len(exp)} rows; cols {cols}")
            for label, rows in (("spark", sorted(a - b)[:3]), ("duckdb", sorted(b - a)[:3])):
                for row in rows:
                    print("   ", label, str(row)[:600])
            bad += 1
        elif odd:
            print(f"FAIL {name}: types {odd}")
            bad += 1
        else:
            print(f"ok   {name}: {len(got)} rows, {took:.1f}s" + ("  EMPTY" if not got else ""))
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
