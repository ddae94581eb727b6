"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def duckdb_tables(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _key(row):
    return tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in row)


def differences(frame, connection, sql: str) -> list[str]:
    """What differs between a Spark frame and a DuckDB statement; empty when nothing does."""
    columns = sorted(frame.columns)
    relation = connection.sql(sql)
    problems = []
    if columns != sorted(relation.columns):
        return [f"columns {columns} != {sorted(relation.columns)}"]
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in frame.schema.fields}
    duck_types = dict(zip(relation.columns, map(str, relation.types)))
    for name in columns:
        if spark_types[name] != duck_types[name]:
            problems.append(f"type of {name}: {spark_types[name]} != {duck_types[name]}")
    ours = Counter(_key(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = Counter(_key(r) for r in connection.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
    if ours != theirs:
        problems.append(f"rows {sum(ours.values())} vs {sum(theirs.values())}; only Spark "
                        f"{list((ours - theirs).items())[:2]}; only SQL {list((theirs - ours).items())[:2]}")
    return problems
