"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

# Type names that count as equal.
_SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float) and math.isnan(value):
        return (1, "nan")
    return (2, repr(value))


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree on columns, types and rows, else what differs."""
    cur = con.execute(sql)
    oracle_types = {d[0]: str(d[1]) for d in cur.description}
    oracle_names = [d[0] for d in cur.description]
    oracle_rows = cur.fetchall()
    types = {f.name: _SAME.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if types != oracle_types:
        return f"schema {types} != {oracle_types}"
    names = sorted(types)
    mine = sorted(tuple(_key(r[n]) for n in names) for r in df.collect())
    at = [oracle_names.index(n) for n in names]
    theirs = sorted(tuple(_key(r[i]) for i in at) for r in oracle_rows)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        shown = [[x[1] for x in side] for side in wrong[0]]
        return f"{len(wrong)} of {len(mine)} rows differ, e.g. {names}: {shown[0]} != {shown[1]}"
    return None
