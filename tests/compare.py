"""Compare registered queries with their SQL: ``python -m tests.compare [folder] [name …]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, int) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 6))
    return str(value)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in data)


def difference(spark_df, con, text: str) -> str | None:
    """None when both agree, else what differs."""
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(text)
    names = [c[0] for c in result.description]
    theirs = rows(names, result.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}; e.g. {sorted(set(ours) ^ set(theirs))[:4]}"
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return f"{len(bad)} of {len(ours)} rows differ, e.g. {bad[:2]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    spark, con, failed = session(), connect(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            text = oracle_sql().get(name)
            verdict = f"rows only: {df.count()}" if text is None else difference(df, con, text)
        except Exception as error:  # noqa: BLE001 - reported per query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failed += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - start:.1f}s {verdict or ''}", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
