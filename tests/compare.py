"""Run registered queries beside their SQL and compare every value.

As a script: ``python tests/compare.py SF_DIR [key ...]``.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _order(row: tuple) -> list:
    return [(v is not None, str(type(v)), v if v is not None else 0) for v in row]


def as_rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(r[i] for i in at) for r in rows), key=_order)


def differences(spark_df, sql: str, con) -> list[str]:
    """Empty when columns, row counts, value types and values agree exactly."""
    names, got = as_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    sql_names, want = as_rows([c[0] for c in result.description], result.fetchall())
    found = []
    if names != sql_names:
        found.append(f"columns {names} vs {sql_names}")
    if len(got) != len(want):
        found.append(f"rows {len(got)} vs {len(want)}")
    for a, b in zip(got, want):
        if a != b or list(map(type, a)) != list(map(type, b)):
            close = all(
                x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12))
                for x, y in zip(a, b)
            )
            found.append(f"{'last digits' if close else 'values'}: {a} vs {b}")
            if len(found) > 3:
                break
    return found


def main(sf_dir: str, only: list[str]) -> int:
    from tidemark.plans import registry
    from tidemark.session import local_session

    spark = local_session()
    con = connect(sf_dir)
    queries, sql = registry.queries(), registry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sql:
                found = differences(df, sql[name], con)
                state = "ok" if not found else "DIFF " + " | ".join(found)
            else:
                state = f"rows only: {len(df.collect())}"
                found = []
        except Exception as e:  # noqa: BLE001
            found, state = ["error"], f"ERROR {str(e)[:600]}"
        bad += bool(found)
        print(f"{name:32s} {time.time() - start:6.2f}s {state}", flush=True)
    print("bad:", bad, "of", len(queries))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
