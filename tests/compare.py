"""Run queries in Spark and DuckDB and compare rows, columns and values.

    python -m tests.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, con, folder, fn, sql):
    """Empty text when both sides agree."""
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if rows else "no rows"
    rel = con.execute(sql)
    rel_types = rel.description
    columns, other = [d[0] for d in rel.description], rel.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(columns)}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [(d[0], types[d[0]], str(d[1])) for d in rel_types if SAME_TYPE.get(types[d[0]]) != str(d[1])]
    if wrong:
        return f"types differ: {wrong}"
    a, b = bag(df.columns, rows), bag(columns, other)
    if a == b:
        return "" if rows else "both empty"
    left, right = list((a - b).elements()), list((b - a).elements())
    names = sorted(columns)
    return f"{names}\n  rows {len(rows)}/{len(other)} spark only {len(left)}: {left[:3]}\n  duckdb only {len(right)}: {right[:3]}"


def main(folder="/root/testdata/sf0.01", *only):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from codehist.session import drop_stages
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            text = difference(spark, con, folder, fn, sql.get(name))
        except Exception as e:  # report and go on with the next query
            text = f"{type(e).__name__}: {str(e)[:700]}"
        drop_stages(spark)
        bad += bool(text)
        print(f"{'DIFF' if text else 'ok  '} {name} {time.time() - start:.1f}s {text}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main(*sys.argv[1:])
