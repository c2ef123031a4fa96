"""Run registered queries against DuckDB on the same files and compare the rows."""

from __future__ import annotations

import logging
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return str(value)


def rows_of(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [[canonical(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns, strict=True), key=lambda r: tuple("" if v is None else v for v in r))


def as_arrow(con: duckdb.DuckDBPyConnection, sql: str):
    result = con.sql(sql).to_arrow_table()
    return result


def compare(spark, con, sf_dir: str, function, sql: str | None) -> str | None:
    """None if the rows agree (or there is no SQL), else what differs."""
    ours = function(spark, sf_dir).toArrow()
    if sql is None:
        return None if ours.num_rows > 0 else "no rows"
    theirs = as_arrow(con, sql)
    our_names, our_rows = rows_of(ours)
    their_names, their_rows = rows_of(theirs)
    if our_names != their_names:
        return f"columns differ: {our_names} / {their_names}"
    kinds = [
        (n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type))
        for n in our_names
        if str(ours.schema.field(n).type) != str(theirs.schema.field(n).type)
    ]
    if len(our_rows) != len(their_rows):
        return f"row counts differ: {len(our_rows)} / {len(their_rows)}"
    for mine, other in zip(our_rows, their_rows, strict=True):
        if mine != other:
            return f"rows differ: {our_names} {mine} / {other} {kinds}"
    if not our_rows:
        return "no rows"
    return f"types: {kinds}" if kinds and "--types" in sys.argv else None


def main() -> None:
    from flowloom.session import local_session
    from registry import ORACLES, QUERIES

    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = args[0]
    wanted = args[1:]
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    spark = local_session("compare", "8")
    con = connect(sf_dir)
    failed = 0
    for name, function in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, function, ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - start
        mark = "ok" if problem is None else "FAIL"
        oracle = "" if name in ORACLES else " (no SQL)"
        print(f"{mark:5}{name}{oracle} {took:.2f}s {problem or ''}", flush=True)
        failed += problem is not None
    print("failed:", failed)


if __name__ == "__main__":
    main()
