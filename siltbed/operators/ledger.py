"""Run ledger: an append-only Parquet table of run events, and everything derived from it.

The current state of a run is its event with the highest ``seq``.
"""

from __future__ import annotations

import io
import uuid
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltbed import storage
from siltbed.functions.schema import drifted
from siltbed.operators.quality import drop_percent, row_drop_violated
from siltbed.operators.sequence import with_previous

LEDGER_SCHEMA = """
    seq bigint, job_id string, pipeline_id string, status string, triggered_by string,
    rows_read bigint, rows_written bigint, duration_ms bigint, error string,
    failed_files array<string>, schema_hash string, schema_changed boolean,
    last_schema array<struct<name: string, type: string, nullable: boolean>>,
    watermark string, source_connection_id string, destination_path string, logs array<string>,
    created_at timestamp, started_at timestamp, finished_at timestamp
"""

# Statuses and page limits.
GOOD = ("success", "partial_success")
OPEN = ("queued", "running")
HISTORY_LIMITS = (1, 500)
AUDIT_LIMITS = (1, 200)


def append(spark: SparkSession, path: str, event: dict, ddl: str = LEDGER_SCHEMA) -> None:
    """Add one event as one small file, visible as a whole or not at all; times must carry a zone.

    One row of metadata needs no job: it is written where the caller runs, through the file system Spark uses.
    """
    row = pa.Table.from_pylist([event], schema=to_arrow_schema(T.StructType.fromDDL(ddl)))
    data = io.BytesIO()
    pq.write_table(row, data)
    storage.publish(spark, path, f"event-{event['seq']}-{uuid.uuid4().hex}.parquet", data.getvalue())


def read(spark: SparkSession, path: str) -> DataFrame:
    if not storage.exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def compact(spark: SparkSession, source: str, target: str, files: int = 1) -> None:
    """Copy many one-row files into few; callers then switch the ledger path."""
    read(spark, source).repartition(files).write.parquet(target)


def latest(runs: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """Last event per key.

    Spark limits a ranked window to the first row per key before the shuffle as well as after it, so a key with very
    many events sends one row per task.
    """
    newest_first = Window.partitionBy(key).orderBy(F.desc(seq))
    return runs.withColumn("__rank", F.row_number().over(newest_first)).filter("__rank = 1").drop("__rank")


def page(df: DataFrame, order: list[Column], limit: int, offset: int, limits: tuple[int, int]) -> DataFrame:
    if not limits[0] <= limit <= limits[1]:
        raise ValueError(f"limit must lie between {limits[0]} and {limits[1]}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def history(
    runs: DataFrame,
    pipeline: str | None = None,
    status: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Runs (their newest events) newest first, optionally of one pipeline or status; planned as a distributed top-k."""
    runs = latest(runs)
    if pipeline is not None:
        runs = runs.filter(F.col("pipeline_id") == pipeline)
    if status is not None:
        runs = runs.filter(F.col("status") == status)
    return page(runs, [F.desc("created_at"), F.desc("seq")], limit, offset, HISTORY_LIMITS)


def run(runs: DataFrame, job_id: str) -> DataFrame:
    return latest(runs.filter(F.col("job_id") == job_id))


def duration_ms(started: Column, finished: Column) -> Column:
    """Whole milliseconds between two timestamps, cut off towards zero; NULL when either is missing."""
    micros = F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.call_function("div", micros, F.lit(1000))


def log_lines(current: DataFrame) -> DataFrame:
    """Stored logs as numbered lines; expects one row per run."""
    return current.select("job_id", F.posexplode("logs").alias("line_no", "line"))


def log_slice(lines: DataFrame, since: int, job_id: str | None = None) -> DataFrame:
    """Log lines at or after an offset, for one run or all, with the offset to ask for next.

    A run without new lines has one row without a line, whose next offset is the one asked for.
    """
    if job_id is not None:
        lines = lines.filter(F.col("job_id") == job_id)
    new = F.col("line_no") >= since
    ends = lines.groupBy("job_id").agg((F.count_if(new) + since).alias("next_offset"))
    return ends.join(lines.filter(new), "job_id", "left")


def _is_good_pipeline_run() -> Column:
    return (
        F.col("pipeline_id").isNotNull()
        & F.col("status").isin(*GOOD)
        & (F.coalesce(F.col("triggered_by"), F.lit("manual")) != "backfill")
    )


def _good_pipeline_runs(runs: DataFrame) -> DataFrame:
    """Finished, accepted pipeline runs that count as a pipeline's own progress: no backfills, no ad-hoc jobs."""
    return runs.filter(_is_good_pipeline_run())


def watermarks(runs: DataFrame) -> DataFrame:
    """Current watermark per pipeline: that of its last accepted run which was not a backfill."""
    known = _good_pipeline_runs(runs).filter(F.col("watermark").isNotNull())
    marks = known.select("pipeline_id", "seq", F.col("watermark").alias("last_watermark"))
    return latest(marks, "pipeline_id").drop("seq")


def last_success(runs: DataFrame) -> DataFrame:
    return (
        runs.filter(F.col("status").isin(*GOOD) & F.col("pipeline_id").isNotNull())
        .groupBy("pipeline_id")
        .agg(F.max("finished_at").alias("last_success_at"))
    )


def schema_registry(runs: DataFrame) -> DataFrame:
    """Last known schema per pipeline, from accepted runs that recorded one."""
    known = _good_pipeline_runs(runs).filter(F.col("schema_hash").isNotNull())
    return latest(known, "pipeline_id").select(
        "pipeline_id",
        F.col("schema_hash").alias("last_schema_hash"),
        "last_schema",
        F.col("finished_at").alias("updated_at"),
    )


def schema_drift(runs: DataFrame) -> DataFrame:
    """Accepted runs with the hash of the run before and a flag telling whether it changed."""
    known = _good_pipeline_runs(runs).filter(F.col("schema_hash").isNotNull())
    return with_previous(known, "pipeline_id", "seq", {"previous_hash": "schema_hash"}).withColumn(
        "schema_changed", drifted(F.col("schema_hash"), F.col("previous_hash"))
    )


def with_accepted_hash(runs: DataFrame) -> DataFrame:
    """Runs with the schema hash of the last accepted run before, the base for alerts: failed runs, backfills and runs
    without a hash between two accepted ones don't move it."""
    counts = _is_good_pipeline_run() & F.col("schema_hash").isNotNull()
    return with_previous(runs, "pipeline_id", "seq", {"previous_hash": "schema_hash"}, counts)


def row_drops(runs: DataFrame, max_drop_pct: float) -> DataFrame:
    """Accepted runs with the row count of the run before, the loss, and whether it exceeds the limit."""
    compared = with_previous(_good_pipeline_runs(runs), "pipeline_id", "seq", {"previous_rows": "rows_read"})
    rows, previous = F.col("rows_read"), F.col("previous_rows")
    return compared.withColumns(
        {"drop_pct": drop_percent(rows, previous), "violated": row_drop_violated(rows, previous, F.lit(max_drop_pct))}
    )


def lineage(runs: DataFrame) -> DataFrame:
    """Distinct edges from source connection to destination, with how often each was used."""
    return (
        latest(runs)
        .filter(F.col("source_connection_id").isNotNull() | F.col("destination_path").isNotNull())
        .groupBy("source_connection_id", "pipeline_id", "destination_path")
        .agg(F.count(F.lit(1)).alias("runs"))
    )


def by_trigger(runs: DataFrame) -> DataFrame:
    return latest(runs).groupBy("triggered_by").agg(F.count(F.lit(1)).alias("runs"))


def pipeline_state(spark: SparkSession, path: str, pipeline_id: str, dead_before: datetime | None = None) -> dict:
    """What the next run of one pipeline needs to know: watermark, last schema hash, previous row count, and whether
    there may be runs started before ``dead_before`` that never ended."""
    if not storage.exists(spark, path):
        return {"watermark": None, "rows_read": None, "schema_hash": None, "unfinished": False}
    mine = read(spark, path).filter(F.col("pipeline_id") == pipeline_id)
    good = _is_good_pipeline_run()
    wanted = ("watermark", "rows_read", "schema_hash")
    old = F.lit(False) if dead_before is None else F.col("started_at") < F.lit(dead_before)
    row = mine.agg(
        *[F.max_by(c, F.when(good & F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in wanted],
        # Every run has an event when it starts and one when it ends.
        (F.count_if(old & (F.col("status") == "running")) > F.count_if(old & (F.col("status") != "running"))).alias("unfinished"),
    ).first()
    return row.asDict()


def next_seq(moment: datetime) -> int:
    """Event number from the clock in microseconds: ordered, and needing no shared counter."""
    return int(moment.timestamp() * 1_000_000)
