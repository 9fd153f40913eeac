"""Run registered queries against their SQL twins in DuckDB: ``python -m tests.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """Explanation of the difference, or ``None``."""
    df = fn(spark, sf_dir)
    got_columns, got = rows_of(df.columns, df.collect())
    if sql is None:
        return None
    cursor = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} against {want_columns}"
    if got != want:
        only_got, only_want = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"{got.total()} rows against {want.total()}; only here {only_got}; only there {only_want}"
    if not got:
        return "both sides are empty"
    return None


def local_session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    from siltbed.session import configure

    builder = SparkSession.builder.master(f"local[{cpus}]").appName("siltbed").config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false"
    )
    return (
        configure(builder)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            problem = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
