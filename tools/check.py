"""Compares every registered query with its DuckDB SQL on one scale.

python tools/check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proofline.plans.catalog import registered  # noqa: E402
from proofline.plans.fixtures import TABLES  # noqa: E402
from proofline.plans.oracle import oracles  # noqa: E402
from proofline.session import local_session  # noqa: E402


def text(value: object) -> str:
    if value is None or value != value:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 9))
    return str(value)


def table(columns: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session(8)
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    sqls, bad = oracles(), []
    for name, fn in registered().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            df = fn(spark, sf_dir)
            mine = table(df.columns, df.collect())
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: spark: {str(error)[:500]}", flush=True)
            continue
        seconds = time.time() - begin
        if name not in sqls:
            print(f"rows {name}: {len(mine)} ({seconds:.1f}s)", flush=True)
            continue
        try:
            cursor = con.execute(sqls[name])
            columns = [d[0] for d in cursor.description]
            theirs = table(columns, cursor.fetchall())
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: duckdb: {str(error)[:700]}", flush=True)
            continue
        if sorted(columns) != sorted(df.columns) or mine != theirs:
            bad.append(name)
            only_mine = [r for r in mine if r not in set(theirs)][:3]
            only_theirs = [r for r in theirs if r not in set(mine)][:3]
            print(f"DIFF {name}: {len(mine)} vs {len(theirs)} {sorted(df.columns)} {sorted(columns)}\n"
                  f"  spark  {only_mine}\n  duckdb {only_theirs}", flush=True)
        else:
            print(f"ok   {name}: {len(mine)} ({seconds:.1f}s)", flush=True)
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(folder, sys.argv[2:]) > 0)
