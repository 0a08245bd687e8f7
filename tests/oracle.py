"""Compare registered queries with their SQL: python tests/oracle.py [folder] [names…]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def key(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, float) else "f"),
                  round(v, 3) if isinstance(v, float) else str(v)) for v in row)


def compare(spark, con, folder: str, name: str, run, sql: str | None):
    """Empty string if equal (or no SQL), else the difference."""
    df = run(spark, folder)
    names = sorted(df.columns)
    rows = [tuple(normal(r[c]) for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    if sql is None:
        return "" if rows else "no rows", len(rows)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {names} != {sorted(columns)}", len(rows)
    order = [columns.index(c) for c in names]
    kinds = {"BIGINT": "bigint", "DOUBLE": "double", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}
    spark_types = dict(df.dtypes)
    for d in result.description:
        if kinds.get(str(d[1]).upper(), str(d[1])) != spark_types[d[0]] and str(d[1]) not in ("NUMBER", "STRING"):
            return f"type of {d[0]}: {d[1]} != {spark_types[d[0]]}", len(rows)
    other = [tuple(normal(r[i]) for i in order) for r in result.fetchall()]
    if len(rows) != len(other):
        return f"{len(rows)} rows != {len(other)}", len(rows)
    rows.sort(key=key)
    other.sort(key=key)
    bad = [(a, b) for a, b in zip(rows, other, strict=True) if a != b]
    return (f"{len(bad)} of {len(rows)} differ in {names}: {bad[:2]}" if bad else ""), len(rows)


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = session(), connect(folder)
    runs, checks = queries(), oracle_sql()
    failed = 0
    for name, run in runs.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, folder, name, run, checks.get(name))
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        failed += bool(problem)
        mark = "FAIL" if problem else ("ok" if name in checks else "rows")
        print(f"{mark:4} {name} {n} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed", failed, "of", len(wanted or runs))


if __name__ == "__main__":
    main()
