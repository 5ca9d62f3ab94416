"""Runs catalog queries on Spark and their SQL on DuckDB over the same tables, and compares rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    return round(value, 6) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, sf_dir: str, query, sql: str | None):
    """(problem or None, row count)."""
    df = query(spark, sf_dir)
    got, got_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return (None if got_names else "no columns"), len(got)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want, want_names = rows_of(names, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows != {len(want)} rows; only here {extra}; only there {missing}", len(got)
    return None, len(got)


def main() -> None:
    import __spark_entry__ as entry
    from conftest import session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = session()
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, query, sql.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        kind = "sql" if name in sql else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {n} rows {time.time() - began:.1f}s {(problem or '')[:1200]}", flush=True)


if __name__ == "__main__":
    main()
