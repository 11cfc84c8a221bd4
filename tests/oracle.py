"""Run registered queries and compare them with their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME_PREFIX ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return plain(float(value)) if hasattr(value, "as_tuple") else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, query, sql):
    start = time.time()
    df = query(spark, sf)
    found = df.collect()
    seconds = time.time() - start
    if sql is None:
        return f"rows {len(found)}", seconds
    cursor = con.execute(sql)
    expected = cursor.fetchall()
    have = rows_of(df.columns, [tuple(r) for r in found])
    want = rows_of([d[0] for d in cursor.description], expected)
    if have == want:
        return f"OK {len(found)}", seconds
    if have[0] != want[0]:
        return f"COLUMNS {have[0]} != {want[0]}", seconds
    extra, missing = sorted(set(have[1]) - set(want[1])), sorted(set(want[1]) - set(have[1]))
    return f"DIFF {len(found)} vs {len(expected)} spark-only {len(extra)} {extra[:2]} sql-only {len(missing)} {missing[:2]}", seconds


def main() -> None:
    from fraygraph.session import local_session
    from fraygraph.plans import catalogue

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf)
    for name, query in catalogue.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            result, seconds = compare(spark, con, sf, name, query, catalogue.SQL.get(name))
        except Exception as error:  # noqa: BLE001
            result, seconds = f"ERROR {type(error).__name__} {str(error)[:600]}", 0.0
            if len(wanted) == 1:
                traceback.print_exc()
        print(f"{name:32s} {seconds:6.1f}s {result}", flush=True)


if __name__ == "__main__":
    main()
