"""Run every query next to its SQL in DuckDB and report differences.

    python tools/compare.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tickloom.plans.catalog import ORACLES, QUERIES  # noqa: E402

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def oracle(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def differences(df, connection, name) -> tuple[str, int]:
    """What is wrong with the result of query ``name``, if anything, and its size."""
    columns, rows = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return "no oracle", len(rows)
    result = connection.execute(ORACLES[name])
    wanted_columns, wanted = sorted_rows([d[0] for d in result.description], result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}", len(rows)
    if len(rows) != len(wanted):
        return f"{len(rows)} rows, wanted {len(wanted)}", len(rows)
    off = [(a, b) for a, b in zip(rows, wanted) if a != b]
    return (f"{len(off)} rows differ, first {off[0]}" if off else ""), len(rows)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = oracle(folder), 0
    for name in names:
        began = time.time()
        try:
            problem, size = differences(QUERIES[name](spark, folder), connection, name)
        except Exception as error:  # report and go on with the next query
            problem, size = f"{type(error).__name__}: {str(error)[:600]}", -1
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':5}{name:28}{size:8}{time.time() - began:7.2f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
