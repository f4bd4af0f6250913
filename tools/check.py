"""Compare registered queries with their oracle SQL: ``check.py SF_DIR [name-part ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidemark.plans.catalog import ORACLES, QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            if math.isnan(v):
                return "null"
            return f"{v:.9g}"
        return "null" if v is None else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


SQL_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def _sql_types(con, name):
    rel = con.sql(ORACLES[name])
    return rel.columns, rel.types


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLES:
        return (len(rows) > 0, f"rows only: {len(rows)}", took)
    types = {n: str(t) for n, t in zip(*_sql_types(con, name))}
    for field in df.schema.fields:
        want = SQL_TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if types.get(field.name) != want:
            print(f"     type of {name}.{field.name}: {want} vs {types.get(field.name)}")
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    expected = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return (False, f"columns {sorted(df.columns)} vs {sorted(names)}", took)
    mine, theirs = canonical(df.columns, rows), canonical(names, expected)
    if mine == theirs:
        return (len(rows) > 0, f"{len(rows)} rows", took)
    extra = sorted(set(mine) - set(theirs))[:2]
    missing = sorted(set(theirs) - set(mine))[:2]
    return (False, f"{len(mine)} vs {len(theirs)} rows; only spark {extra}; only sql {missing}", took)


def main():
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, note, took = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {note}", flush=True)
    print(f"{bad} failures")
    spark.stop()


if __name__ == "__main__":
    main()
