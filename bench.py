"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores. Each table is one file of one row group,
which a single task would read; before the clock starts the tables are written again as a file per core, as a
lake would hold them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from telemill.plans.registry import registered

HEADLINE = (
    "documents_findings_summary",
    "documents_redacted",
    "documents_all_findings",
    "pages_hostnames",
    "checksum_functions",
    "json_redaction",
    "ingest_outcomes",
    "ledger_rows",
    "sigma_detections",
    "ocsf_mixed",
    "aws_cloudtrail",
    "host_lines",
    "infer_log_format",
    "parse_json",
    "infer_schema_json",
    "quality_components",
    "dedupe_first",
    "admit_by_capacity",
    "ledger_apply",
    "pack_files",
    "rule_scores",
    "fleet_state",
    "sigma_rule_table",
    "stream_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("telemill-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    split_dir = f"{tempfile.mkdtemp(prefix='bench-')}/{Path(sf_dir).name}"
    for table in Path(sf_dir).glob("*.parquet"):
        spark.read.parquet(str(table)).repartition(int(cpus)).write.parquet(f"{split_dir}/{table.name}")
    queries, seconds = registered(), {}
    # One small run starts the JVM and the Python workers.
    queries["json_redaction"][0](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        started = time.perf_counter()
        # Every column of every row is computed; nothing goes to the driver.
        queries[name][0](spark, split_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
