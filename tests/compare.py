"""Run registered queries against their SQL. ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

import __spark_entry__ as registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def difference(spark, con, folder: str, name: str) -> str | None:
    """None when the query gives exactly the rows and column types of its SQL."""
    got = registry.queries()[name](spark, folder)
    want = con.execute(registry.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in want.description}
    columns = sorted(types)
    if sorted(got.columns) != columns:
        return f"columns {sorted(set(got.columns) ^ set(columns))}"
    for c, t in got.dtypes:
        if SAME_TYPES.get(t) != types[c]:
            return f"type of {c}: {t} / {types[c]}"
    at = {d[0]: n for n, d in enumerate(want.description)}
    expected = Counter(tuple(str(r[at[c]]) for c in columns) for r in want.fetchall())
    actual = Counter(tuple(str(r[c]) for c in columns) for r in got.collect())
    if actual == expected:
        plan = got._jdf.queryExecution().executedPlan().toString()
        pairs = [j for j in ("CartesianProduct", "NestedLoopJoin") if j in plan]
        return f"the plan forms pairs: {pairs}" if pairs else None
    lost, extra = expected - actual, actual - expected
    show = lambda rows: [dict(zip(columns, r)) for r in list(rows)[:2]]
    counts = f"{sum(actual.values())}/{sum(expected.values())} rows"
    return f"{counts}; missing {show(lost)}; extra {show(extra)}"


def main() -> None:
    from tests.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(registry.queries())
    spark, con, bad = local_session(), connect(folder), 0
    for name in names:
        if name not in registry.oracle_sql():
            print(f"{name}: no SQL", flush=True)
            continue
        started = time.time()
        try:
            problem = difference(spark, con, folder, name)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{name}: {problem or 'ok'} ({time.time() - started:.1f}s)", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")


if __name__ == "__main__":
    main()
