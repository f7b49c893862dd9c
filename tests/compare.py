"""Rows of a Spark query and of its DuckDB SQL, in one comparable form."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def _sorted(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _sorted(df.columns, df.collect())


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), _sorted(columns, found.fetchall())


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}


def kinds_differ(df, con: duckdb.DuckDBPyConnection, sql: str) -> dict:
    there = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (k, there.get(c)) for c, k in df.dtypes if _KINDS.get(k, k) != there.get(c)}
