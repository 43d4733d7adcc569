"""Side-by-side comparison of a bound query with its oracle SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
    "TIMESTAMP": "timestamp", "BOOLEAN": "boolean", "FLOAT": "float", "SMALLINT": "smallint",
}


def compare(df, con, sql: str) -> dict:
    """Row counts, column names and types, and unequal rows of the two results."""
    columns = sorted(df.columns)
    kinds = dict(df.dtypes)
    spark_rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    problems = []
    if sorted(names) != columns:
        return {"problems": [f"columns {columns} != {sorted(names)}"], "rows": len(spark_rows)}
    order = [names.index(c) for c in columns]
    sql_rows = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    odd = [
        f"{c}: {kinds[c]} != {types[c]}"
        for c in columns
        if KINDS.get(types[c], types[c]) != kinds[c].replace("timestamp_ntz", "timestamp")
    ]
    if odd:
        problems.append("types " + ", ".join(odd))
    if len(spark_rows) != len(sql_rows):
        problems.append(f"{len(spark_rows)} rows != {len(sql_rows)}")
    a, b = sorted(spark_rows, key=repr), sorted(sql_rows, key=repr)
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    if differing:
        x, y = differing[0]
        parts = [(c, u, v) for c, u, v in zip(columns, x, y) if u != v]
        problems.append(f"{len(differing)} unequal rows, first: {parts} in {x}")
    return {"problems": problems, "rows": len(spark_rows)}
