"""Runs a registered query on Spark and its SQL twin on DuckDB and compares all rows.

``python -m tests.oracle [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    """Values of both engines in one form; decimals keep their digits."""
    if isinstance(value, Decimal):
        return format(value.normalize(), "f") if value else "0"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir: str, function, sql: str | None) -> tuple[bool, str]:
    df = function(spark, sf_dir)
    columns, got = rows_of(df.columns, df.collect())
    total = sum(got.values())
    if sql is None:
        return total > 0, f"{total} rows (no SQL)"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    wanted_columns, wanted = rows_of(names, result.fetchall())
    if columns != wanted_columns:
        return False, f"columns {columns} != {wanted_columns}"
    if got == wanted:
        return total > 0, f"{total} rows"
    extra, missing = list((got - wanted).items())[:2], list((wanted - got).items())[:2]
    return False, f"{total} vs {sum(wanted.values())} rows\n   spark {extra}\n   sql   {missing}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    spark, con = session(), connect(sf)
    failed = 0
    for name in [c for c in chosen if c in queries]:
        started = time.time()
        try:
            good, note = compare(spark, con, sf, queries[name], oracles.get(name))
        except Exception as problem:  # noqa: BLE001
            good, note = False, f"{type(problem).__name__}: {str(problem)[:300]}"
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:32s} {time.time() - started:6.2f}s  {note}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")
