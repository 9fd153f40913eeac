"""One landing run: extract, filter, check, mask, stage, gate, promote, record.

Order matters: the run is announced before it reads anything, the schema is hashed and checked before masking, gates are
evaluated before anything becomes visible, files are promoted before the outcome is recorded, and the watermark is part
of the ledger event. The staged write is the run's one pass over the data. Whatever a promotion needs to be recorded
later is kept beside it, so a run that dies at any point is completed or undone by ``recover_unfinished``; the next run
of the same pipeline does that for runs beyond the time limit.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltbed import extensions, storage
from siltbed.functions.masking import mask_columns, mask_names
from siltbed.functions.schema import check_contract, descriptors, schema_hash
from siltbed.operators import ledger, monitoring
from siltbed.operators.incremental import after_watermark, in_window, resolve_key
from siltbed.operators.quality import GateError, check_gates
from siltbed.plans.spec import BackfillWindow, PipelineSpec, RunContext, SpecError, check_destination, resolve_path
from siltbed.sinks import parquet
from siltbed.sources.files import LandingOptions, finish_landing, read_landing
from siltbed.sources.jdbc import JdbcSource, read_jdbc
from siltbed.sources.rest import read_rest
from siltbed.sources.sql import query_source


# Fixed value: seconds after which a run that did not end counts as dead.
RUN_TIMEOUT = 3600
#: What a valid promotion keeps for the ledger.
RECORDED = (
    "status", "rows_read", "rows_written", "failed_files", "schema_hash", "schema_changed", "last_schema", "watermark", "logs"
)


@dataclass
class RunResult:
    job_id: str
    pipeline_id: str | None
    status: str = "running"
    path: str | None = None
    rows_read: int | None = None
    rows_written: int | None = None
    error: str | None = None
    schema_hash: str | None = None
    schema_changed: bool = False
    last_schema: list[dict] | None = None
    watermark: str | None = None
    failed_files: list[str] = field(default_factory=list)
    left_out: int = 0
    logs: list[str] = field(default_factory=list)
    alerts: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class Extracted:
    """Rows of a source, the files left out, and what to do with the source once the rows are visible."""

    rows: DataFrame
    failed_files: list[str] = field(default_factory=list)
    left_out: int = 0
    finish: Callable[[], None] = lambda: None
    scratch: list[str] = field(default_factory=list)  # tables of unmasked rows, to be deleted when the run is over


def extract(spark: SparkSession, spec: PipelineSpec, ctx: RunContext, ledger_path: str | None = None) -> Extracted:
    options = spec.source_options
    if spec.source == "sql":
        return Extracted(query_source(spark, spec.query, ctx))
    if spec.source == "jdbc":
        return Extracted(read_jdbc(spark, JdbcSource(query=spec.query, **options), ctx))
    if spec.source == "rest":
        scratch: list[str] = []
        return Extracted(read_rest(spark, **options, scratch=scratch), scratch=scratch)
    if spec.source == "files":
        wanted = LandingOptions(**options)
        runs = ledger.read(spark, ledger_path) if ledger_path and wanted.manifest else None
        landed = read_landing(spark, wanted, run_id=ctx.run_id, runs=runs)
        return Extracted(
            landed.rows, landed.failed_files, landed.left_out, lambda: finish_landing(spark, wanted, landed, ctx.run_id),
            [landed.scratch] if landed.scratch else [],
        )
    return Extracted(extensions.get_source(spec.source)(spark, spec, ctx))


def run_pipeline(
    spark: SparkSession,
    spec: PipelineSpec,
    ctx: RunContext,
    ledger_path: str,
    root: str = "",
    window: BackfillWindow | None = None,
) -> RunResult:
    """Run a pipeline once and record the outcome; errors end up in the result and the ledger, not in the caller.

    ``root`` is put in front of the destination, e.g. a bucket or a mount. The ledger gets one event when the run
    starts and one when it ends. ``alerts`` of the result holds the address and body of every alert to send.
    """
    if window is not None and spec.incremental_key is None:
        raise SpecError("a backfill needs an incremental_key")
    started = datetime.now(UTC)
    dead_before = started - timedelta(seconds=RUN_TIMEOUT)
    state = ledger.pipeline_state(spark, ledger_path, spec.pipeline_id, dead_before)
    if state["unfinished"]:
        recover_unfinished(spark, ledger_path, spec.pipeline_id, dead_before)
        state = ledger.pipeline_state(spark, ledger_path, spec.pipeline_id, dead_before)
    trigger = "backfill" if window is not None else ctx.triggered_by
    result = RunResult(ctx.run_id, spec.pipeline_id, path=f"{root}{resolve_path(spec.destination, ctx)}")
    spark.addTag(ctx.run_id)
    record_run(spark, ledger_path, spec.connection_id, trigger, ctx, started, None, result)
    scratch: list[str] = []
    try:
        _land(spark, spec, ctx, window, state, result, ledger_path, scratch)
    except Exception as error:  # any failure ends the run as failed, with nothing promoted
        _fail(spark, result, error)
    finally:
        spark.removeTag(ctx.run_id)
    record_run(spark, ledger_path, spec.connection_id, trigger, ctx, started, datetime.now(UTC), result)
    parquet.discard(spark, result.path, ctx.run_id)
    if scratch:
        storage.delete_trees(spark, scratch)
    if spec.webhook_url:
        result.alerts = _alerts(spark, spec, state, result)
    return result


def _alerts(spark: SparkSession, spec: PipelineSpec, state: dict, result: RunResult) -> list[dict]:
    """What the finished run raises, by the same rules as for a whole ledger: the base is the last accepted hash."""
    fields = {name: getattr(result, name) for name in ("pipeline_id", "job_id", "status", "error", "rows_read", "rows_written")}
    row = fields | {
        "schema_hash": result.schema_hash, "previous_hash": state["schema_hash"], "alert_on": list(spec.alert_on),
        "webhook_url": spec.webhook_url,
    }
    raised = monitoring.alerts(spark.createDataFrame([row], monitoring.ALERT_INPUT), spec.webhook_hosts)
    return [r.asDict() for r in monitoring.alert_payloads(raised, datetime.now(UTC)).collect()]


def run_extract(
    spark: SparkSession, df: DataFrame, path: str, ctx: RunContext, ledger_path: str, replace: bool = True
) -> RunResult:
    """Ad-hoc landing of any DataFrame: recorded in the ledger, but without watermark or schema history."""
    result = RunResult(ctx.run_id, None, path=check_destination(path, ""))
    started = datetime.now(UTC)
    record_run(spark, ledger_path, None, ctx.triggered_by, ctx, started, None, result)
    try:
        result.schema_hash = schema_hash(df.schema)
        _publish(spark, parquet.stage(df, path, ctx.run_id), replace, result)
    except Exception as error:
        _fail(spark, result, error)
    record_run(spark, ledger_path, None, ctx.triggered_by, ctx, started, datetime.now(UTC), result)
    parquet.discard(spark, path, ctx.run_id)
    return result


def _land(
    spark: SparkSession,
    spec: PipelineSpec,
    ctx: RunContext,
    window: BackfillWindow | None,
    state: dict,
    result: RunResult,
    ledger_path: str,
    scratch: list[str],
) -> None:
    source = extract(spark, spec, ctx, ledger_path)
    scratch += source.scratch
    rows, result.failed_files, result.left_out = source.rows, source.failed_files, source.left_out
    if window is not None:
        rows = in_window(rows, spec.incremental_key, window)
    elif spec.extraction_mode == "incremental":
        rows = after_watermark(rows, spec.incremental_key, state["watermark"])

    result.schema_hash = schema_hash(rows.schema)
    result.last_schema = descriptors(rows.schema)
    result.schema_changed = bool(state["schema_hash"] and state["schema_hash"] != result.schema_hash)
    if result.schema_changed:
        result.logs.append(f"WARNING: schema changed from {state['schema_hash'][:8]} to {result.schema_hash[:8]}")
    if spec.expected_schema:
        contract = check_contract(rows.schema, spec.expected_schema)
        if contract.error:
            raise GateError(contract.error)
        if contract.extra:
            result.logs.append(f"WARNING: columns beyond the contract {list(contract.extra)}")

    by_max_key = spec.watermark_from == "max_key"
    key = resolve_key(rows, spec.incremental_key).name if by_max_key else None
    if key is not None and key in mask_names(rows, spec.pii_columns).values():
        raise SpecError(f"{key!r} cannot be masked and give the watermark")
    if spec.write_tasks:
        rows = rows.repartition(spec.write_tasks)
    unknown = sorted(set(spec.pii_columns) - set(mask_names(rows, spec.pii_columns)))
    if unknown:
        result.logs.append(f"WARNING: no such columns to mask {unknown}")
    rows = mask_columns(rows, spec.pii_columns)
    if spec.sink != "parquet":
        _write_elsewhere(spec, rows, state, result)
        _finish(source, result)
        result.watermark = None if window is not None else ctx.run_ts.astimezone(UTC).isoformat()
        return
    partition = None
    if spec.partition_by == "ingest_date":
        rows = parquet.with_ingest_date(rows, ctx.local_date)
        partition = parquet.INGEST_DATE
    staged = parquet.stage(rows, result.path, ctx.run_id, partition, spec.compression, key)
    check_gates(staged.rows_read, spec.min_rows_expected, spec.max_rows_drop_pct, state["rows_read"])
    replace = spec.extraction_mode == "full_refresh" and window is None
    if window is None:
        result.watermark = (
            (staged.max_key and datetime.fromisoformat(staged.max_key).isoformat()) or state["watermark"]
            if by_max_key
            else ctx.run_ts.astimezone(UTC).isoformat()
        )
    _publish(spark, staged, replace, result)
    _finish(source, result)


def _write_elsewhere(spec: PipelineSpec, rows: DataFrame, state: dict, result: RunResult) -> None:
    """A gated sink is written in one pass, and the gates decide whether it commits or aborts. A plain function has no way back,
    so gates need a count of their own before it writes anything."""
    sink, path = extensions.get_sink(spec.sink), result.path
    least, most_lost, before = spec.min_rows_expected, spec.max_rows_drop_pct, state["rows_read"]
    seen = Observation()
    if isinstance(sink, extensions.GatedSink):
        observed = rows.observe(seen, F.count(F.lit(1)).alias(parquet.ROWS_READ))
        extensions.write_gated(observed, path, sink, lambda n: check_gates(n, least, most_lost, before))
        written = None
    else:
        if least is not None or most_lost is not None:
            check_gates(rows.count(), least, most_lost, before)
        written = sink(rows.observe(seen, F.count(F.lit(1)).alias(parquet.ROWS_READ)), path)
    result.rows_read = seen.get[parquet.ROWS_READ]
    result.rows_written = result.rows_read if written is None else written
    result.logs.append(_resolve(result))


def _finish(source: Extracted, result: RunResult) -> None:
    """Rows are visible by now, so a source that cannot be tidied up is a warning and undoes nothing."""
    try:
        source.finish()
    except Exception as error:
        result.logs.append(f"WARNING: the source was not tidied up: {_summary(error)}")


def _fail(spark: SparkSession, result: RunResult, error: Exception) -> None:
    """End a run as failed with the target as it was, unless its rows had become valid before the error."""
    text = str(error) if isinstance(error, (GateError, SpecError)) else _summary(error)
    try:
        if parquet.recover(spark, result.path, result.job_id):
            result.logs.append(f"WARNING: after the rows had become valid: {text}")
            return
    except Exception as other:  # the store may be the reason for the failure; recover_unfinished can be tried later
        result.logs.append(f"WARNING: clean-up failed: {_summary(other)}")
    result.status, result.error, result.watermark = "failed", text, None
    result.logs.append(f"ERROR: {text}")


def recover_unfinished(
    spark: SparkSession, ledger_path: str, pipeline_id: str | None = None, started_before: datetime | None = None
) -> dict[str, str]:
    """Settle runs that never finished (all, or those of a pipeline, or those started before a moment) and record the
    outcome; job ids with their final status.

    A run whose rows had become valid is completed and gets the outcome noted with them. Others are undone and failed.
    """
    settled = {}
    open_runs = ledger.latest(ledger.read(spark, ledger_path)).filter(F.col("status") == "running")
    if pipeline_id is not None:
        open_runs = open_runs.filter(F.col("pipeline_id") == pipeline_id)
    if started_before is not None:
        open_runs = open_runs.filter(F.col("started_at") < F.lit(started_before))
    for event in open_runs.collect():
        path, job_id = event["destination_path"], event["job_id"]
        now = datetime.now(UTC)
        closing = {"seq": ledger.next_seq(now), "finished_at": now, "status": "failed", "error": "run did not finish"}
        promoted = parquet.recover(spark, path, job_id)
        if promoted:
            closing |= {"status": "success", "error": None} | json.loads(promoted.record or "{}")
        times = {name: event[name].replace(tzinfo=UTC) for name in ("created_at", "started_at") if event[name]}
        ledger.append(spark, ledger_path, event.asDict(recursive=True) | times | closing)
        settled[job_id] = closing["status"]
    return settled


def _publish(spark: SparkSession, staged: parquet.StagedWrite, replace: bool, result: RunResult) -> None:
    result.rows_read, result.rows_written = staged.rows_read, staged.rows_written
    landed = _resolve(result)
    record = json.dumps({name: getattr(result, name) for name in RECORDED})
    parquet.promote(spark, staged, replace, keep_marker=True, record=record)
    result.logs.append(landed)


def _resolve(result: RunResult) -> str:
    """failed on a count mismatch, partial_success when files were left out, else success; what to log about it."""
    if result.rows_read != result.rows_written:
        raise GateError(f"{result.rows_read} rows read but {result.rows_written} written")
    left_out = len(result.failed_files) + result.left_out
    result.status = "partial_success" if left_out else "success"
    return f"{result.rows_read} rows landed" + (f", {left_out} files left out" if left_out else "")


def record_run(
    spark: SparkSession,
    ledger_path: str,
    connection_id: str | None,
    trigger: str,
    ctx: RunContext,
    started: datetime,
    finished: datetime | None,
    result: RunResult,
) -> None:
    """The run's event: of its start without, of its end with ``finished``."""
    ledger.append(
        spark,
        ledger_path,
        {
            "seq": ledger.next_seq(finished or started),
            "job_id": result.job_id,
            "pipeline_id": result.pipeline_id,
            "status": result.status,
            "triggered_by": trigger,
            "rows_read": result.rows_read,
            "rows_written": result.rows_written,
            "duration_ms": finished and int((finished - started).total_seconds() * 1000),
            "error": result.error,
            "failed_files": result.failed_files,
            "schema_hash": result.schema_hash,
            "schema_changed": result.schema_changed,
            "last_schema": result.last_schema,
            "watermark": result.watermark,
            "source_connection_id": connection_id,
            "destination_path": result.path,
            "logs": result.logs,
            "created_at": ctx.run_ts,
            "started_at": started,
            "finished_at": finished,
        },
    )


def _summary(error: Exception) -> str:
    return traceback.format_exception_only(error)[-1].strip()
