"""Compare registered queries with their SQL: ``python tests/oracle_check.py sf0.01 [name …]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="oracle-check-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spark_time = time.time() - start
    if sql is None:
        return True, spark_time, 0.0, f"{len(got[1])} rows, no SQL"
    start = time.time()
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    duck_time = time.time() - start
    if got == want:
        return True, spark_time, duck_time, f"{len(got[1])} rows"
    extra = sorted(set(got[1]) - set(want[1]))[:3]
    lacking = sorted(set(want[1]) - set(got[1]))[:3]
    note = f"{got[0]} vs {want[0]}; {len(got[1])} vs {len(want[1])} rows; extra {extra}; lacking {lacking}"
    return False, spark_time, duck_time, note


def main():
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = session(), duck(sf_dir)
    bad = []
    for name in names:
        try:
            ok, s, d, note = compare(
                spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql().get(name)
            )
        except Exception as error:  # noqa: BLE001
            ok, s, d, note = False, 0.0, 0.0, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} spark {s:6.2f}s duck {d:6.2f}s  {note}", flush=True)
        bad += [] if ok else [name]
    print("failed:", bad)


if __name__ == "__main__":
    main()
