"""Compare a registered query with its SQL on the same tables.

    python -m tests.oracle [--sf /root/testdata/sf0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, _norm(x)) for k, x in sorted(value.items()))
    if hasattr(value, "item"):
        return _norm(value.item())
    return value


def _rows(arrow) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(arrow.column_names)
    types = [str(arrow.schema.field(n).type).replace("large_", "") for n in names]
    columns = [arrow.column(n).to_pylist() for n in names]
    return names, types, sorted((tuple(_norm(x) for x in row) for row in zip(*columns)), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names, types, rows = _rows(spark_df.toArrow())
    o_names, o_types, o_rows = _rows(con.execute(sql).to_arrow_table())
    if names != o_names:
        return f"columns {names} vs {o_names}"
    if types != o_types:
        differing = [(n, a, b) for n, a, b in zip(names, types, o_types) if a != b]
        kinds = [(n, a, b) for n, a, b in differing if "decimal" in a + b or ("int" in a) != ("int" in b) or ("double" in a) != ("double" in b)]
        if kinds:
            return f"types {kinds}"
    if len(rows) != len(o_rows):
        extra = list(set(rows) - set(o_rows))[:2], list(set(o_rows) - set(rows))[:2]
        return f"rows {len(rows)} vs {len(o_rows)}: {extra}"
    if rows != o_rows:
        wrong = [(a, b) for a, b in zip(rows, o_rows) if a != b]
        return f"{len(wrong)} of {len(rows)} rows differ, e.g. {str(wrong[0])[:700]}"
    return None


def main() -> None:
    from hayloft.session import local_session
    from workload import all_oracles, all_queries

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(os.cpu_count() or 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, oracles = all_queries(), all_oracles()
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            problem = compare(df, con, oracles[name]) if name in oracles else None
            count = f" rows-only {df.count()}" if name not in oracles else ""
        except Exception as failure:  # noqa: BLE001 - reported per query
            problem, count = f"{type(failure).__name__}: {str(failure)[:900]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s{count} {problem or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
