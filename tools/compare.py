"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tools/compare.py <folder> [name ...]
"""
from __future__ import annotations

import sys
import tempfile
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def local_session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("compare")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="regionflow-"))
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda row: tuple((v is not None, str(type(v)), v) for v in row)
    return [names[i] for i in order], sorted((tuple(row[i] for i in order) for row in rows), key=key)


def compare(spark, con, folder, name, run, sql) -> str:
    frame = run(spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return f"rows only: {len(got[1])}"
    answer = con.sql(sql)
    want = rows_of(answer.columns, answer.fetchall())
    if got[0] != want[0]:
        return f"DIFFERS columns {got[0]} / {want[0]}"
    if got[1] == want[1]:
        return f"equal: {len(got[1])}"
    extra = [r for r in got[1] if r not in set(want[1])][:3]
    lost = [r for r in want[1] if r not in set(got[1])][:3]
    return f"DIFFERS {len(got[1])} / {len(want[1])} rows\n     only spark {extra}\n     only sql   {lost}"


def main() -> int:
    from regionflow.queries import ORACLES, QUERIES
    folder, chosen = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    failures = 0
    for name, run in QUERIES.items():
        if chosen and name not in chosen:
            continue
        begin = time.time()
        try:
            verdict = compare(spark, con, folder, name, run, ORACLES.get(name))
        except Exception as error:
            verdict = "ERROR " + (traceback.format_exc()[-1500:] if chosen else str(error)[:600])
        failures += not verdict.startswith(("equal", "rows"))
        print(f"{name:28s} {time.time() - begin:6.1f}s {verdict}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(bool(main()))
