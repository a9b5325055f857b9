"""Compare queries with DuckDB: ``python tests/oracle.py <sf_dir> [query …] [spark.setting=value …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def _cell(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, db, sf_dir: str, query, sql: str) -> list[str]:
    """What differs; nothing if the query and its SQL agree."""
    df = query(spark, sf_dir)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = canonical(names, result.fetchall())
    actual = canonical(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if actual[0] != expected[0]:
        problems.append(f"columns {actual[0]} against {expected[0]}")
    for name, spark_type in df.dtypes:
        if _SAME_TYPE.get(spark_type) != types.get(name):
            problems.append(f"type of {name}: {spark_type} against {types.get(name)}")
    if len(actual[1]) != len(expected[1]):
        problems.append(f"{len(actual[1])} rows against {len(expected[1])}")
    differing = [(a, e) for a, e in zip(actual[1], expected[1]) if a != e]
    if differing:
        problems.append(f"{len(differing)} rows differ, first {differing[0]}")
    return problems


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1]
    names = [a for a in sys.argv[2:] if "=" not in a]
    settings = dict(a.split("=", 1) for a in sys.argv[2:] if "=" in a)
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
    spark = builder.config("spark.ui.showConsoleProgress", "false").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    for name, query in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            problems = compare(spark, db, sf_dir, query, oracle_sql()[name])
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        print(f"{'ok  ' if not problems else 'FAIL'} {name} {time.time() - started:.1f}s {problems or ''}", flush=True)
