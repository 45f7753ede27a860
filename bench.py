"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs whole and writes to a no-op sink."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from auditlake.plans import corpus
from auditlake.plans.queries import QUERIES

HEADLINE = ["scan_rules", "call_join", "detect_all", "merge_findings", "scan_findings", "severity_counts",
            "bench_metrics", "file_metadata", "txt_neutralize", "project_info", "fix_file", "line_shift",
            "reason_prompts", "seq_pairs", "report_rows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    corpus.code_files(spark, sf_dir).limit(1).collect()  # start the session before the clock
    size = corpus.code_files(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.octet_length("code")).alias("b")).first()
    files = size["n"]
    took = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    scan = took[names[0] if "scan_findings" not in took else "scan_findings"]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "files": files,
                      "files_per_sec": round(files / scan, 1), "mb": round(size["b"] / 1e6, 1),
                      "mb_per_sec_core": round(size["b"] / 1e6 / scan / int(cpus), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
