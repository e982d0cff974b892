"""Run the registered queries and compare them with their checking SQL in an embedded engine.

python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from checks import catalog
from gradus.session import build_session


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _value(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    return "NULL" if v is None else str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def check(spark, db, name: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    sql = catalog.ORACLES.get(name)
    if sql is None:
        return len(rows) > 0, f"rows only: {len(rows)} ({took:.1f}s)"
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    wrong = {n: (t, kinds[n]) for n, t in df.dtypes if SAME_TYPE.get(t) != kinds[n]}
    if wrong:
        return False, f"types {wrong}"
    mine, theirs = canonical(df.columns, rows), canonical(columns, expected)
    if mine == theirs:
        return True, f"{len(rows)} rows ({took:.1f}s)"
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
    return False, f"{len(mine)} / {len(theirs)} rows, {diff}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = check(spark, db, name, sf_dir)
        except Exception as error:  # a broken query must not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
