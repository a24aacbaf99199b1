"""Time the headline queries; prints one JSON line.

Each query runs once to a no-op sink, so all columns are computed and nothing is collected.
``queries`` has the whole time, ``build`` the part of it that went by before the result ran:
building the plan and the small jobs that compile specs. Every query starts without cached
tables and without remembered selector probes, and none of the warm-up queries is timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from gleanery.functions import xpath  # noqa: E402
from gleanery.plans import catalog  # noqa: E402

HEADLINE = (
    "extract_h1",
    "site_results_json",
    "error_records",
    "element_checks",
    "target_results",
    "url_normalize",
    "url_dedup",
    "spec_violations",
    "token_bucket",
    "breaker_replay",
    "retry_plan",
    "scrape_histogram",
    "active_sessions",
    "success_rate_windowed",
    "p95_windowed",
    "alert_failure_rate",
    "load_summary",
    "to_jsonable",
)

WARM_UP = ("scrapes_total", "presence_mode", "breaker_state", "url_validate")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        # building large expressions: do not record a Python call site for every node
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    # start the JVM's and the Python workers' engines; the timed runs share nothing else with these
    for name in WARM_UP:
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds, build = {}, {}
    for name in names:
        spark.catalog.clearCache()
        xpath.forget_verdicts()
        started = time.perf_counter()
        result = registered[name](spark, sf_dir)
        build[name] = round(time.perf_counter() - started, 3)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "build": build, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
