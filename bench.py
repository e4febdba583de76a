"""Time the headline queries; print one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelog import queries  # noqa: E402
from tidelog.table import Table  # noqa: E402

HEADLINE = ["visible_scan", "scan_range", "multi_get", "merge_runs", "snapshot_plus_log", "valid_log_prefix", "set_batch_dedupe", "orders_multi_get"]
ROWS = 1_000_000


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        began = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - began, 3)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    own = queries.queries()
    noop(own["visible_scan"](spark, sf_dir))  # starts workers and compiles code
    for name in HEADLINE:
        timed(name, lambda name=name: noop(own[name](spark, sf_dir)))
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        table = Table(spark, f"{folder}/t", "snapshot")
        key = F.format_string("key%06d", "id")
        timed("ingest_1m", lambda: table.set_batch(spark.range(ROWS).select(key.alias("key"), key.alias("value"))))
        timed("ingest_1m_again", lambda: table.set_batch(spark.range(ROWS).select(key.alias("key"), F.lit("x" * 20).alias("value"))))
        timed("reopen_and_replay_2m", lambda: Table(spark, f"{folder}/t").count())
        timed("table_scan_1000", lambda: table.scan("key500000", "key501000").collect())
        asked = spark.range(100_000).select(F.format_string("key%06d", F.floor(F.rand(42) * ROWS).cast("long")).cast("binary").alias("key"))
        timed("table_multi_get_100k", lambda: noop(table.multi_get(asked)))
        timed("compact_2m", table.compact)
        rates = {
            "ingest_rows_per_s": round(ROWS / times["ingest_1m"]),
            "replay_rows_per_s": round(2 * ROWS / times["reopen_and_replay_2m"]),
            "multi_get_rows_per_s": round(100_000 / times["table_multi_get_100k"]),
            "write_amplification": round(table.write_amplification(), 3),
        }
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    total = round(sum(times[n] for n in HEADLINE), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
