"""The given tables seen as a run ledger, a pipeline registry, a page feed and so on.

Every view is a projection of a whole table; the SQL texts are the same projections for the oracle.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.plans.spec import RunContext

# 10:00 on 25 March 1998 in America/Sao_Paulo (UTC-3 on that day).
CLOCK = datetime(1998, 3, 25, 13, 0, tzinfo=UTC)
NOW = datetime(2024, 1, 31, tzinfo=UTC)


def context(**changes) -> RunContext:
    return RunContext(run_ts=CLOCK, **changes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run events: one pipeline per user, several events per job."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    started = F.timestamp_micros(
        F.unix_micros(F.col("ts").cast("timestamp")) - F.round(F.col("value") * 1000).cast("bigint") * 1000
    ).cast("timestamp_ntz")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("job_id"),
        F.col("user_id").cast("string").alias("pipeline_id"),
        F.when(kind == "error", "failed").when(kind == "signup", "partial_success").otherwise("success").alias("status"),
        F.when(kind == "purchase", "backfill")
        .when(kind == "click", "manual")
        .when(kind == "signup", "api")
        .otherwise("schedule")
        .alias("triggered_by"),
        F.floor("value").alias("rows_read"),
        F.floor("value").alias("rows_written"),
        F.sha2("props", 256).alias("schema_hash"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("watermark"),
        kind.alias("source_connection_id"),
        F.concat(F.lit("bronze/"), kind, F.lit("/")).alias("destination_path"),
        "value",
        started.alias("started_at"),
        F.when(kind != "view", F.col("ts")).alias("ended_at"),
        F.col("ts").alias("finished_at"),
        F.col("ts").alias("created_at"),
        kind.alias("event_type"),
    )


RUNS_SQL = """runs AS (
  SELECT event_id AS seq,
         user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS job_id,
         user_id::VARCHAR AS pipeline_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial_success' ELSE 'success' END AS status,
         CASE event_type WHEN 'purchase' THEN 'backfill' WHEN 'click' THEN 'manual' WHEN 'signup' THEN 'api'
              ELSE 'schedule' END AS triggered_by,
         floor(value)::BIGINT AS rows_read,
         floor(value)::BIGINT AS rows_written,
         sha256(props) AS schema_hash,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS watermark,
         event_type AS source_connection_id,
         'bronze/' || event_type || '/' AS destination_path,
         value, ts AS finished_at, ts AS created_at, event_type
  FROM events)"""

GOOD_SQL = "status IN ('success', 'partial_success')"


def pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pipeline definitions; a negative balance stands for a deleted one."""
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("pipeline_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") >= 5, F.concat(F.lit("https://hooks.example.com/"), F.col("c_custkey"))).alias(
            "webhook_url"
        ),
        F.when(segment == "BUILDING", 60)
        .when(segment == "AUTOMOBILE", 1440)
        .when(segment == "MACHINERY", 10080)
        .when(segment == "FURNITURE", 43200)
        .alias("sla_minutes"),
        F.when(F.col("c_acctbal") > 5000, F.expr("TIMESTAMP_NTZ'2024-01-30 23:30:00'")).alias("sla_notified_at"),
        F.when(F.col("c_acctbal") < 0, F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")).alias("deleted_at"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.when(segment == "BUILDING", F.array(F.lit("failed")))
        .when(segment == "MACHINERY", F.array(F.lit("schema_changed")))
        .when(segment == "AUTOMOBILE", F.array(F.lit("failed"), F.lit("schema_changed")))
        .alias("alert_on"),
        (
            F.expr("TIMESTAMP_NTZ'2023-11-14 22:13:20'") - F.make_dt_interval(secs=F.col("c_custkey").cast("decimal(18,6)"))
        ).alias("created_at"),
    )


PIPELINES_SQL = """pipelines AS (
  SELECT c_custkey::VARCHAR AS pipeline_id, c_name AS name,
         CASE WHEN c_nationkey >= 5 THEN 'https://hooks.example.com/' || c_custkey END AS webhook_url,
         CASE c_mktsegment WHEN 'BUILDING' THEN 60 WHEN 'AUTOMOBILE' THEN 1440 WHEN 'MACHINERY' THEN 10080
              WHEN 'FURNITURE' THEN 43200 END AS sla_minutes,
         CASE WHEN c_acctbal > 5000 THEN TIMESTAMP '2024-01-30 23:30:00' END AS sla_notified_at,
         CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS deleted_at,
         c_acctbal >= 0 AS is_active,
         CASE c_mktsegment WHEN 'BUILDING' THEN ['failed'] WHEN 'MACHINERY' THEN ['schema_changed']
              WHEN 'AUTOMOBILE' THEN ['failed', 'schema_changed'] END AS alert_on,
         make_timestamp((1700000000 - c_custkey) * 1000000) AS created_at
  FROM customer)"""


# Descriptors of the payload each event type would deliver: signups lack a column, clicks change a type, purchases add
# a column.
_BASE = (("event_id", "int64", False), ("ts", "timestamp[us]", True), ("value", "double", True))
_BY_TYPE = {
    "signup": _BASE[:2],
    "click": (*_BASE[:2], ("value", "string", True)),
    "purchase": (*_BASE, ("coupon", "string", True)),
}


def _descriptor_column(entries) -> Column:
    return F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(o).alias("nullable"))
            for n, t, o in entries
        ]
    )


def delivered_schema() -> Column:
    actual = _descriptor_column(_BASE)
    for name, entries in _BY_TYPE.items():
        actual = F.when(F.col("event_type") == name, _descriptor_column(entries)).otherwise(actual)
    return actual


def described_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        delivered_schema().alias("last_schema"),
        _descriptor_column(_BASE).alias("expected_schema"),
    )


def _descriptor_sql(entries) -> str:
    return "[" + ", ".join(
        f"{{'name': '{n}', 'type': '{t}', 'nullable': {str(o).lower()}}}" for n, t, o in entries
    ) + "]"


DESCRIBED_SQL = f"""described AS (
  SELECT event_id AS seq,
         CASE event_type {' '.join(f"WHEN '{k}' THEN {_descriptor_sql(v)}" for k, v in _BY_TYPE.items())}
              ELSE {_descriptor_sql(_BASE)} END AS last_schema,
         {_descriptor_sql(_BASE)} AS expected_schema
  FROM events)"""
