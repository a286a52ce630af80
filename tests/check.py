"""Compare registered queries with their oracle: python tests/check.py SF_DIR [key ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        value = value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, key, folder, connection):
    from __spark_entry__ import oracle_sql, queries

    start = time.time()
    df = queries()[key](spark, folder)
    got = df.collect()
    took = time.time() - start
    oracle = oracle_sql().get(key)
    if oracle is None:
        return "rows", len(got), took, ""
    result = connection.sql(oracle)
    want_columns, want_types = result.columns, [str(t) for t in result.types]
    want = result.fetchall()
    if sorted(want_columns) != sorted(df.columns):
        return "FAIL", len(got), took, f"columns {sorted(df.columns)} vs {sorted(want_columns)}"
    names = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
             "INTEGER": "int", "TIMESTAMP": "timestamp_ntz"}
    types = dict(df.dtypes)
    loose = [
        f"{c}:{types[c]}/{t}" for c, t in zip(want_columns, want_types)
        if names.get(t, t) != types[c]
    ]
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(want_columns, want)
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:2]
        missing = [r for r in b if r not in set(a)][:2]
        return "FAIL", len(a), took, f"rows {len(a)} vs {len(b)}; only here {extra}; only there {missing}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return "FAIL", len(a), took, f"{len(bad)} rows differ on {sorted(df.columns)}, e.g. {bad[0]}"
    return "ok", len(a), took, ("types " + ", ".join(loose)) if loose else ""


def main(argv):
    from __spark_entry__ import queries
    from cairnway.session import local_session

    folder = argv[0]
    keys = argv[1:] or list(queries())
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    failed = []
    for key in keys:
        try:
            status, count, took, note = compare(spark, key, folder, connection)
        except Exception as exc:  # a broken query is a finding, not the end of the run
            status, count, took, note = "ERROR", 0, 0.0, f"{type(exc).__name__}: {str(exc)[:900]}"
        if status in ("FAIL", "ERROR"):
            failed.append(key)
        print(f"{status:5} {key:34} rows={count:<7} {took:5.2f}s {note[:1500]}", flush=True)
    print(f"{len(keys) - len(failed)}/{len(keys)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
