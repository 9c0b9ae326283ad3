"""Runs a query and its SQL twin and compares rows and types."""

from __future__ import annotations

import duckdb
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _kinds(table: pa.Table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=repr)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def differences(spark_table: pa.Table, sql_table: pa.Table) -> list[str]:
    out = []
    left, right = _kinds(spark_table), _kinds(sql_table)
    if left != right:
        out.append(f"types: {sorted(set(left.items()) ^ set(right.items()))}")
    if set(left) != set(right):
        return out
    a, b = _rows(spark_table), _rows(sql_table)
    if len(a) != len(b):
        out.append(f"rows: {len(a)} against {len(b)}")
    for x, y in zip(a, b):
        if not all(_same(p, q) for p, q in zip(x, y)):
            out.append(f"first difference: {x} against {y}")
            break
    return out
