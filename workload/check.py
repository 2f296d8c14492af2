"""Compare Spark queries with their SQL: python -m workload.check [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from panelwright.scratch import release
from panelwright.session import build_session
from workload.registry import QUERIES, SQL

DEFAULT_DIR = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _ordered(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


def compare(spark: SparkSession, connection, sf_dir: str, name: str) -> str | None:
    """None when a query and its SQL agree in columns and every value, else what differs."""
    return differences(QUERIES[name](spark, sf_dir), connection, SQL[name])


def differences(frame: DataFrame, connection, sql: str) -> str | None:
    actual = [tuple(row) for row in frame.collect()]
    cursor = connection.execute(sql)
    columns = [item[0] for item in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    left, right = _ordered(frame.columns, actual), _ordered(columns, expected)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, columns {sorted(columns)}: {wrong[:3]}"
    kinds = {type(v).__name__ for row in left for v in row} ^ {
        type(v).__name__ for row in right for v in row
    }
    return f"value types differ: {kinds}" if kinds else None


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments else DEFAULT_DIR
    names = arguments[1:] or list(QUERIES)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report every query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}",
              flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    release(spark)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
