"""Landing runs: staged writes, promotion, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltbed import extensions, storage
from siltbed.plans.runner import RunResult, run_extract, run_pipeline
from siltbed.plans.spec import BackfillWindow, PipelineSpec
from siltbed.queries.fixtures import EVENT_SCHEMA, as_uri, event_rows, write_drop
from siltbed.queries.registry import query
from siltbed.queries.views import context, table
from siltbed.session import scratch_path
from siltbed.sinks import parquet


def _root(spark) -> tuple[str, str]:
    base = scratch_path(spark, "landed")
    return f"{base}/", f"{base}/ledger"


def _succeeded(result: RunResult) -> RunResult:
    if result.status != "success":
        raise RuntimeError(f"run ended as {result.status}: {result.error}")
    return result


def _table_source(sf_dir: str, name: str, condition: str = "true"):
    return lambda spark, spec, ctx: table(spark, sf_dir, name).filter(condition)


@query("full_refresh_write", "SELECT * FROM lineitem")
def full_refresh_write(spark, sf_dir):
    """The second run replaces what the first one landed."""
    root, ledger_path = _root(spark)
    extensions.source("lineitem_returned", _table_source(sf_dir, "lineitem", "l_returnflag = 'R'"))
    extensions.source("lineitem_all", _table_source(sf_dir, "lineitem"))
    for name in ("lineitem_returned", "lineitem_all"):
        spec = PipelineSpec("lineitem", "bronze/lineitem", source=name)
        _succeeded(run_pipeline(spark, spec, context(), ledger_path, root))
    return parquet.read_landed(spark, f"{root}bronze/lineitem")


@query("incremental_append_write", "SELECT * FROM orders")
def incremental_append_write(spark, sf_dir):
    """A first run takes the orders known by then, a second one appends what is newer than the largest key landed."""
    root, ledger_path = _root(spark)
    extensions.source("orders_then", _table_source(sf_dir, "orders", "o_orderdate < TIMESTAMP_NTZ'1998-01-01'"))
    extensions.source("orders_now", _table_source(sf_dir, "orders"))
    for name in ("orders_then", "orders_now"):
        spec = PipelineSpec(
            "orders", "bronze/orders", source=name, extraction_mode="incremental",
            incremental_key="o_orderdate", watermark_from="max_key",
        )
        _succeeded(run_pipeline(spark, spec, context(), ledger_path, root))
    return parquet.read_landed(spark, f"{root}bronze/orders")


@query("ingest_date_partition", "SELECT *, '1998-03-25' AS _date FROM orders")
def ingest_date_partition(spark, sf_dir):
    root, ledger_path = _root(spark)
    extensions.source("orders_now", _table_source(sf_dir, "orders"))
    spec = PipelineSpec("orders", "bronze/orders", source="orders_now", partition_by="ingest_date")
    _succeeded(run_pipeline(spark, spec, context(), ledger_path, root))
    return parquet.read_landed(spark, f"{root}bronze/orders")


@query("staged_promote", "SELECT * FROM customer")
def staged_promote(spark, sf_dir):
    """Nothing is visible after staging; everything is after promotion, and staging is gone."""
    path = scratch_path(spark, "staged")
    staged = parquet.stage(table(spark, sf_dir, "customer"), path, "r1")
    if next(storage.data_files(spark, path), None) is not None:
        raise RuntimeError("staged files are visible")
    parquet.promote(spark, staged, replace=True)
    if storage.exists(spark, staged.staging):
        raise RuntimeError("staging was left behind")
    return parquet.read_landed(spark, path)


@query("failed_run_leaves_target", "SELECT * FROM customer")
def failed_run_leaves_target(spark, sf_dir):
    root, ledger_path = _root(spark)
    extensions.source("customer_all", _table_source(sf_dir, "customer"))
    spec = PipelineSpec("customer", "bronze/customer", source="customer_all")
    _succeeded(run_pipeline(spark, spec, context(), ledger_path, root))
    gated = PipelineSpec("customer", "bronze/customer", source="customer_all", min_rows_expected=10**15)
    if run_pipeline(spark, gated, context(), ledger_path, root).status != "failed":
        raise RuntimeError("the gate did not hold")
    return parquet.read_landed(spark, f"{root}bronze/customer")


@query(
    "row_count_reconcile",
    """SELECT o_orderstatus, count(*) AS rows_read, count(*) AS rows_written, true AS reconciled
       FROM orders GROUP BY 1""",
)
def row_count_reconcile(spark, sf_dir):
    root, ledger_path = _root(spark)
    orders = table(spark, sf_dir, "orders")
    result = _succeeded(run_extract(spark, orders, f"{root}bronze/orders", context(), ledger_path))
    read = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows_read"))
    landed = parquet.read_landed(spark, result.path)
    written = landed.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows_written"))
    return read.join(written, "o_orderstatus", "full").select(
        "o_orderstatus", "rows_read", "rows_written", F.col("rows_read").eqNullSafe(F.col("rows_written")).alias("reconciled")
    )


@query("full_refresh_empty_partition", "SELECT *, '1998-03-25' AS _date FROM customer")
def full_refresh_empty_partition(spark, sf_dir):
    """A refresh without rows writes no partition and so replaces none, of its own day or another."""
    root, ledger_path = _root(spark)
    extensions.source("customer_all", _table_source(sf_dir, "customer"))
    extensions.source("customer_none", _table_source(sf_dir, "customer", "false"))
    for name in ("customer_all", "customer_none"):
        spec = PipelineSpec("customer", "bronze/customer", source=name, partition_by="ingest_date")
        _succeeded(run_pipeline(spark, spec, context(), ledger_path, root))
    return parquet.read_landed(spark, f"{root}bronze/customer")


@query("full_refresh_same_run", "SELECT * FROM customer")
def full_refresh_same_run(spark, sf_dir):
    """A run repeated under its own id replaces what its first attempt landed."""
    root, ledger_path = _root(spark)
    extensions.source("customer_few", _table_source(sf_dir, "customer", "c_mktsegment = 'BUILDING'"))
    extensions.source("customer_all", _table_source(sf_dir, "customer"))
    for name in ("customer_few", "customer_all"):
        spec = PipelineSpec("customer", "bronze/customer", source=name)
        _succeeded(run_pipeline(spark, spec, context(run_id="job-1"), ledger_path, root))
    return parquet.read_landed(spark, f"{root}bronze/customer")


def _table_sink(root: str) -> str:
    """A sink of Parquet files that tasks write aside and that are renamed into view when the run commits."""

    def store():
        from pyarrow import fs

        return fs.FileSystem.from_uri(as_uri(root))

    def write(path, part, batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, base = store()
        name = f"{base}/_waiting/part-{part:05d}.parquet"
        files.create_dir(f"{base}/_waiting")
        if batches := list(batches):
            with files.open_output_stream(name) as out:
                pq.write_table(pa.Table.from_batches(batches), out)
        return name if batches else None

    def commit(path, names):
        files, base = store()
        for name in filter(None, names):
            files.move(name, f"{base}/{name.rsplit('/', 1)[-1]}")

    def abort(path, names):
        files, _ = store()
        for name in filter(None, names):
            files.delete_file(name)

    extensions.gated_sink("parquet_table", write, commit, abort)
    return root


@query("gated_sink_commit", "SELECT * FROM customer")
def gated_sink_commit(spark, sf_dir):
    """A run whose gate fails aborts and shows nothing; the next one commits."""
    root, ledger_path = _root(spark)
    extensions.source("customer_all", _table_source(sf_dir, "customer"))
    shown = _table_sink(storage.qualified(spark, scratch_path(spark, "table")))
    for least, wanted in ((10**15, "failed"), (1, "success")):
        spec = PipelineSpec("customer", "bronze/c", source="customer_all", sink="parquet_table", min_rows_expected=least)
        result = run_pipeline(spark, spec, context(), ledger_path, root)
        if result.status != wanted:
            raise RuntimeError(f"run ended as {result.status}: {result.error}")
        if wanted == "failed" and any(storage.iter_files(spark, shown)):
            raise RuntimeError("an aborted run left files")
    return spark.read.parquet(shown)


@query("landing_claims", "SELECT * FROM events")
def landing_claims(spark, sf_dir):
    """Two drops of files: a run that fails gives its files back, and no file is landed by two runs."""
    root, ledger_path = _root(spark)
    drop = scratch_path(spark, "drop")
    events = table(spark, sf_dir, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    options = {"paths": (f"{drop}/drop=0",), "parser": "json", "schema": EVENT_SCHEMA, "manifest": f"{root}manifest"}
    runs = (("ts < '2024-01-16'", 10**15, "failed"), (None, 1, "success"), ("ts >= '2024-01-16'", 1, "success"), (None, 0, "success"))
    for part, least, wanted in runs:
        if part:
            write_drop(events.filter(part), drop, "json")
        spec = PipelineSpec(
            "events", "bronze/events", source="files", source_options=options, extraction_mode="incremental",
            incremental_key="ts", min_rows_expected=least,
        )
        result = run_pipeline(spark, spec, context(), ledger_path, root, BackfillWindow("1900-01-01", "2100-01-01"))
        if result.status != wanted:
            raise RuntimeError(f"run ended as {result.status}: {result.error}")
    return event_rows(parquet.read_landed(spark, f"{root}bronze/events"))
