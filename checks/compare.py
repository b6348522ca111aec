"""Run the queries and their SQL side by side: ``python -m checks.compare DIR [KEY ...]``."""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

# DuckDB types by the Spark type they stand for.
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _sorted(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark: SparkSession, sf_dir: str, key: str) -> tuple[str, float]:
    """What differs, or "ok", and the seconds Spark took."""
    start = time.perf_counter()
    result = QUERIES[key](spark, sf_dir)
    rows = [tuple(row) for row in result.collect()]
    seconds = time.perf_counter() - start
    if key not in ORACLE:
        return f"ok, {len(rows)} rows, no SQL", seconds
    with duckdb.connect() as connection:
        for file in Path(sf_dir).glob("*.parquet"):
            connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        wanted = connection.sql(ORACLE[key])
        columns, types, expected = wanted.columns, [str(t) for t in wanted.types], wanted.fetchall()
    if sorted(columns) != sorted(result.columns):
        return f"columns {sorted(result.columns)} instead of {sorted(columns)}", seconds
    got_types = {name: SAME_TYPE.get(kind, kind) for name, kind in result.dtypes}
    if got_types != dict(zip(columns, types)):
        return f"types {got_types} instead of {dict(zip(columns, types))}", seconds
    got, want = _sorted(rows, result.columns), _sorted(expected, columns)
    if got != want:
        different = next((pair for pair in zip(got, want) if pair[0] != pair[1]), None)
        return f"{len(got)} rows against {len(want)}, first difference {str(different)[:600]}", seconds
    return f"ok, {len(rows)} rows", seconds


if __name__ == "__main__":
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gradeloom-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or QUERIES:
        try:
            verdict, took = compare(session, sys.argv[1], name)
        except Exception as failure:
            verdict, took = f"FAILED {type(failure).__name__}: {str(failure)[:700]}", 0.0
        print(f"{name}: {verdict} ({took:.2f} s)", flush=True)
