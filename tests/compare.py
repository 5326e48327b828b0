"""Rows of a query against rows of its SQL, without regard to row or column order."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value if isinstance(value, (str, int, bool, type(None))) else str(value)


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(v) for v in row) for row in df.select(*names).collect())


def sql_rows(db: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = db.execute(sql)
    names = [column[0] for column in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    return [names[i] for i in order], rows


SAME_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def type_differences(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    described = {row[0]: row[1] for row in db.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{field.name}: {field.dataType.simpleString()} / {described.get(field.name)}"
        for field in df.schema
        if SAME_TYPES.get(field.dataType.simpleString()) != described.get(field.name)
    ]
