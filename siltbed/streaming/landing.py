"""Continuous landing of new files, exactly once, with the batch operators applied to every micro-batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltbed import storage
from siltbed.functions.masking import mask_columns
from siltbed.functions.schema import check_contract, descriptors, schema_hash
from siltbed.operators import ledger
from siltbed.operators.quality import GateError, check_gates
from siltbed.plans.runner import RunResult, record_run
from siltbed.plans.spec import RunContext
from siltbed.session import scratch_path
from siltbed.sinks import parquet
from siltbed.sources.files import CORRUPT, SOURCE_FILE, broken_records, split_staged

FILES_PER_TRIGGER = 100
CHECKED_FORMATS = ("json", "csv")


@dataclass(frozen=True)
class StreamOptions:
    path: str
    format: str
    schema: T.StructType | str
    options: dict = field(default_factory=dict)
    files_per_trigger: int = FILES_PER_TRIGGER
    archive: str | None = None


def read_stream(spark: SparkSession, source: StreamOptions) -> DataFrame:
    """New files of a directory. With ``archive``, files are moved there after the batch that read them committed.

    Rows of formats with malformed records carry the text of such a record and their file, which ``land_stream`` uses
    and drops.
    """
    schema = T.StructType.fromDDL(source.schema) if isinstance(source.schema, str) else source.schema
    checked = source.format in CHECKED_FORMATS
    if checked:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = (
        spark.readStream.format(source.format)
        .schema(schema)
        .options(**source.options)
        .option("maxFilesPerTrigger", source.files_per_trigger)
    )
    if source.archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", source.archive)
    if not checked:
        return reader.load(source.path)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).load(source.path)
    return rows.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))


@dataclass(frozen=True)
class BatchRules:
    """What a landing run checks and records, for every micro-batch: contract, gates and an event in the ledger.

    The row drop is measured against the last accepted batch.
    """

    ledger_path: str
    pipeline_id: str
    expected_schema: list[dict] | None = None
    min_rows_expected: int | None = None
    max_rows_drop_pct: float | None = None
    connection_id: str | None = None


def land_stream(
    rows: DataFrame,
    target: str,
    checkpoint: str,
    stream_id: str | None = None,
    pii_columns: dict[str, str] | None = None,
    partition_by: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    rules: BatchRules | None = None,
) -> StreamingQuery:
    """Land everything available now and stop; the next call continues from the checkpoint.

    Each batch is staged and promoted under a name made from its number, and a digest of the checkpoint, so streams with
    checkpoints of their own never touch each other's files. A marker is set before a batch is promoted; only when a
    batch finds its own marker, i.e. is being repeated, is its earlier attempt looked up and replaced, so the normal path
    never lists the growing target. Files are parsed once; a file with a broken record is left out as a whole and
    noted, with its number of broken records, below ``quarantine`` in the checkpoint folder.

    With ``rules`` a batch is a run in the ledger: one event when it has landed (a batch that is repeated after that
    changes nothing), or one for each failed attempt. A broken contract or gate stops the stream with nothing of the
    batch visible; the batch is tried again by the next call.
    """
    checkpoint = checkpoint.rstrip("/")
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run_id = f"{stream_id or 'stream'}-{own}-{batch_id:09d}"
        repeated = storage.exists(spark, f"{checkpoint}/promoting/{run_id}")
        if repeated and rules and accepted(spark, rules, run_id):
            return
        ctx, started = RunContext(run_id=run_id, triggered_by="schedule"), datetime.now(UTC)
        result = RunResult(run_id, rules and rules.pipeline_id, path=target)
        scratch: list[str] = []
        try:
            land_batch(batch, result, repeated, scratch)
        except Exception as error:
            if rules:
                result.status, result.error = "failed", str(error) or type(error).__name__
                record_run(spark, rules.ledger_path, rules.connection_id, ctx.triggered_by, ctx, started, datetime.now(UTC), result)
            raise
        finally:
            storage.delete_trees(spark, scratch)
        if rules:
            record_run(spark, rules.ledger_path, rules.connection_id, ctx.triggered_by, ctx, started, datetime.now(UTC), result)

    def land_batch(batch: DataFrame, result: RunResult, repeated: bool, scratch: list[str]) -> None:
        spark = batch.sparkSession
        if CORRUPT in batch.columns:
            scratch.append(scratch_path(spark, "stream-batch"))
            batch.write.parquet(scratch[0])
            parsed = spark.read.schema(batch.schema).parquet(scratch[0])
            batch, result.failed_files = split_staged(parsed)
            if result.failed_files:
                noted = f"{checkpoint}/quarantine/{result.job_id}"
                broken_records(parsed).write.mode("overwrite").parquet(noted)
            batch = batch.drop(CORRUPT, SOURCE_FILE)
        batch = prepare(batch) if prepare else batch
        state = {"rows_read": None, "schema_hash": None}
        if rules:
            state = ledger.pipeline_state(spark, rules.ledger_path, rules.pipeline_id)
            result.schema_hash, result.last_schema = schema_hash(batch.schema), descriptors(batch.schema)
            result.schema_changed = bool(state["schema_hash"]) and state["schema_hash"] != result.schema_hash
            contract = check_contract(batch.schema, rules.expected_schema or [])
            if contract.error:
                raise GateError(contract.error)
        staged = parquet.stage(mask_columns(batch, pii_columns or {}), target, result.job_id, partition_by)
        result.rows_read, result.rows_written = staged.rows_read, staged.rows_written
        if result.rows_read != result.rows_written:
            raise GateError(f"{result.rows_read} rows read but {result.rows_written} written")
        if rules:
            check_gates(staged.rows_read, rules.min_rows_expected, rules.max_rows_drop_pct, state["rows_read"])
        storage.make_folder(spark, f"{checkpoint}/promoting/{result.job_id}")
        parquet.promote(spark, staged, replace=False, repeated=repeated)
        result.status = "partial_success" if result.failed_files else "success"

    return (
        rows.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def accepted(spark: SparkSession, rules: BatchRules, run_id: str) -> bool:
    own = ledger.run(ledger.read(spark, rules.ledger_path), run_id)
    return not own.filter(F.col("status").isin(*ledger.GOOD)).isEmpty()
