"""Compares a query with its SQL counterpart run by DuckDB over the same files."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differences(con, df, sql: str, tmp: str) -> list:
    df.write.mode("overwrite").parquet(tmp)
    con.execute(f"create or replace temp table want as {sql}")
    con.execute(f"create or replace temp table got as select * from '{tmp}/*.parquet'")
    names = lambda t: sorted(r[0] for r in con.execute(f"describe {t}").fetchall())
    if names("want") != names("got"):
        return [("columns", names("want"), names("got"))]
    cols = ", ".join(f'"{c}"' for c in names("want"))
    ask = lambda a, b: con.execute(f"select * from (select {cols} from {a} except all select {cols} from {b}) limit 3").fetchall()
    return [("only SQL", *ask("want", "got")), ("only Spark", *ask("got", "want"))] if ask("want", "got") or ask("got", "want") else []
