"""Headline timings: one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from siltbed import extensions
from siltbed.functions.masking import mask_columns
from siltbed.operators import purge
from siltbed.plans.runner import run_pipeline
from siltbed.plans.spec import PipelineSpec, RunContext
from siltbed.queries import QUERIES
from siltbed.queries.views import table
from siltbed.session import configure, scratch_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
CLOCK = RunContext(run_ts=datetime(1998, 3, 25, 13, 0, tzinfo=UTC))

# Queries timed as registered; their results are consumed without being collected.
QUERY_KEYS = (
    "query_source_join", "query_source_expr", "watermark_incremental", "watermark_over_cte", "backfill_window",
    "pii_multi", "csv_source", "jsonl_source", "landing_good_rows", "rest_flatten", "full_refresh_write",
    "incremental_append_write", "ingest_date_partition", "run_ledger_latest", "schema_drift_history", "dq_row_drop",
    "sla_breach", "alert_events", "metrics_duration_histogram", "lineage_edges", "soft_delete_cascade",
    "registry_patch", "purge_plan", "landing_stream",
)


def session() -> SparkSession:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("siltbed-bench")
    return (
        configure(builder)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def median_seconds(action: Callable[[], object]) -> float:
    times = []
    for _ in range(REPEATS):
        started = time.perf_counter()
        action()
        times.append(time.perf_counter() - started)
    return round(statistics.median(times), 4)


def landing_timings(spark: SparkSession) -> tuple[dict[str, float], dict[str, float]]:
    """The runs a landing service is judged by, with rows per second."""
    lineitem, orders = table(spark, SF_DIR, "lineitem"), table(spark, SF_DIR, "orders")
    masks = {"l_partkey": "sha256", "l_extendedprice": "redact"}
    extensions.source("bench_lineitem", lambda s, spec, ctx: table(s, SF_DIR, "lineitem"))
    extensions.source("bench_orders", lambda s, spec, ctx: table(s, SF_DIR, "orders"))

    def full_refresh() -> None:
        root = scratch_path(spark, "bench")
        # The given file is a single row group, i.e. a single split.
        spec = PipelineSpec(
            "lineitem", "bronze/lineitem", source="bench_lineitem", pii_columns=masks, write_tasks=int(CPUS)
        )
        if run_pipeline(spark, spec, CLOCK, f"{root}/ledger", f"{root}/").status != "success":
            raise RuntimeError("full refresh failed")

    def incremental() -> None:
        root = scratch_path(spark, "bench")
        spec = PipelineSpec(
            "orders", "bronze/orders", source="bench_orders", extraction_mode="incremental",
            incremental_key="o_orderdate",
        )
        if run_pipeline(spark, spec, CLOCK, f"{root}/ledger", f"{root}/").status != "success":
            raise RuntimeError("incremental run failed")

    def plain_write() -> None:
        mask_columns(lineitem, masks).write.parquet(scratch_path(spark, "bench"))

    def observed_write() -> None:
        seen = Observation()
        mask_columns(lineitem, masks).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(
            scratch_path(spark, "bench")
        )
        seen.get  # noqa: B018

    many = scratch_path(spark, "bench-files")
    table(spark, SF_DIR, "customer").repartition(1000).write.parquet(many)
    times = {
        "run_full_refresh_masked_lineitem": median_seconds(full_refresh),
        "run_incremental_orders": median_seconds(incremental),
        "write_plain": median_seconds(plain_write),
        "write_observed": median_seconds(observed_write),
        "purge_plan_1000_files": median_seconds(lambda: purge.totals(purge.plan(spark, many)).collect()),
    }
    rates = {
        "full_refresh_rows_per_s": round(lineitem.count() / times["run_full_refresh_masked_lineitem"]),
        "incremental_rows_per_s": round(orders.count() / times["run_incremental_orders"]),
    }
    return times, rates


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in QUERY_KEYS:
        consume(QUERIES[name](spark, SF_DIR))  # warm-up
        times[name] = median_seconds(lambda name=name: consume(QUERIES[name](spark, SF_DIR)))
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    landing, rates = landing_timings(spark)
    times |= landing
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds, warm session",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
