"""Run a registered query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb

from riskloom.plans.adapters import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    return str(v)


def rows_of(table: list[dict]) -> list[tuple]:
    return sorted(tuple((k, plain(r[k])) for k in sorted(r)) for r in table)


def oracle_rows(sql: str, sf_dir: str) -> list[dict]:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.sql(sql).to_arrow_table().to_pylist()


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    ours = rows_of(query(spark, sf_dir).toArrow().to_pylist())
    theirs = rows_of(oracle_rows(sql, sf_dir))
    if ours == theirs:
        return ""
    only, other = [r for r in ours if r not in set(theirs)][:2], [r for r in theirs if r not in set(ours)][:2]
    return f"{len(ours)} rows and {len(theirs)}; ours alone: {only}; theirs alone: {other}"
