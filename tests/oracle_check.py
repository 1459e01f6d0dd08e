"""Run a report in Spark and its SQL in DuckDB and compare the rows exactly."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def differences(df, connection, sql: str) -> list[str]:
    """Readable differences; empty when names, types of values, rows and values agree."""
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(names)
    actual = _sorted([tuple(_plain(row[n]) for n in order) for row in df.collect()])
    position = [names.index(n) for n in order]
    wanted = _sorted([tuple(_plain(row[i]) for i in position) for row in expected])
    out = []
    if len(actual) != len(wanted):
        out.append(f"{len(actual)} rows != {len(wanted)} rows")
    mine, theirs = set(actual) - set(wanted), set(wanted) - set(actual)
    if mine or theirs:
        out.append(f"columns {order}; {len(mine)} only in Spark, {len(theirs)} only in SQL")
        out += [f"spark  {row}" for row in _sorted(mine)[:3]]
        out += [f"duckdb {row}" for row in _sorted(theirs)[:3]]
    elif actual != wanted:
        out.append("same distinct rows in different multiplicity")
    return out
