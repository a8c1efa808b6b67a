"""Run a registered query and its SQL twin and compare rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value + 0.0, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(frame, connection, sql) -> tuple[int, list[str]]:
    """(row count, differences) of a Spark frame and an SQL result."""
    spark_rows = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    sql_rows = _rows(columns, result.fetchall())
    problems = []
    if sorted(columns) != sorted(frame.columns):
        problems.append(f"columns {sorted(frame.columns)} against {sorted(columns)}")
    if len(spark_rows) != len(sql_rows):
        problems.append(f"rows {len(spark_rows)} against {len(sql_rows)}")
    if spark_rows and sql_rows:
        kinds = [tuple(type(v).__name__ for v in rows[len(rows) // 2]) for rows in (spark_rows, sql_rows)]
        if kinds[0] != kinds[1]:
            problems.append(f"types {kinds[0]} against {kinds[1]}")
    different = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if different:
        problems.append(f"{len(different)} different rows, first {different[0]}")
    return len(spark_rows), problems


if __name__ == "__main__":
    from spendframe.plans import catalog
    from spendframe.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    session = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    db = duck(sf)
    sqls = catalog.oracle_sql()
    for name, run in catalog.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        began = time.time()
        try:
            if name in sqls:
                count, problems = compare(run(session, sf), db, sqls[name])
            else:
                count, problems = run(session, sf).count(), []
            verdict = "ok" if not problems and count else "BAD"
            print(f"{verdict:4} {name:40} rows={count:<8} {time.time() - began:6.2f}s {'' if name in sqls else '(rows only)'}", *problems)
        except Exception as error:  # noqa: BLE001 - report and go on
            print(f"FAIL {name:40} {type(error).__name__}: {str(error)[:1200]}")
