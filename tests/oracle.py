"""Compare registered queries with their SQL on the test tables.

Run as ``python -m tests.oracle <folder> [query ...]`` from the repository root.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type name to DuckDB type name.
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _rows(columns: dict[str, list]) -> list[tuple]:
    names = sorted(columns)
    return sorted(zip(*(columns[name] for name in names)), key=repr)


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None where names, types and rows agree, else what differs."""
    found = connection.sql(sql)
    theirs_types = {name: str(kind) for name, kind in zip(found.columns, found.types)}
    ours_types = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    if ours_types != theirs_types:
        return f"columns {ours_types} against {theirs_types}"
    theirs = _rows(found.to_arrow_table().to_pydict())
    ours = _rows(df.toArrow().to_pydict())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for mine, other in zip(ours, theirs):
        if repr(mine) != repr(other):
            return f"row {mine} against {other}"
    return None


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from mediaflow.plans import ORACLES, QUERIES

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names or QUERIES:
        begin = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = differences(df, connection, ORACLES[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as failure:
            problem = f"{type(failure).__name__}: {str(failure)[:1500]}"
        kind = "sql" if name in ORACLES else "rows"
        print(f"{name:24} {kind:5} {time.time() - begin:6.2f}s {problem or 'ok'}", flush=True)
        failed += problem is not None
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
