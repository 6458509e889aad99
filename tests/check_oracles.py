"""Runs registered queries against their oracle SQL and prints what differs.

    python tests/check_oracles.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(value) -> str:
    """A value in a form both engines share."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A database with the tables as views."""
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def compare(spark: SparkSession, db, sf_dir: str, run, sql: str | None) -> tuple[str, str]:
    """``ok``, ``rows`` (no oracle) or ``DIFF``, and a line about it."""
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    if sql is None:
        return "rows", f"{len(ours)} rows"
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return "DIFF", f"columns {columns} against {sorted(names)}"
    place = [names.index(c) for c in columns]
    theirs = sorted(tuple(text(r[i]) for i in place) for r in cursor.fetchall())
    if ours == theirs:
        return "ok", f"{len(ours)} rows"
    left, right = set(ours), set(theirs)
    return "DIFF", (
        f"{len(ours)} against {len(theirs)} rows; {columns}\n   ours   {[r for r in ours if r not in right][:2]}"
        f"\n   theirs {[r for r in theirs if r not in left][:2]}"
    )


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, oracle, bad = database(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            verdict, line = compare(spark, db, sf_dir, run, oracle.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict, line = "FAIL", str(error)[:700]
        bad += verdict in ("DIFF", "FAIL")
        print(f"{verdict:5} {name}: {line}, {time.time() - started:.1f}s", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
