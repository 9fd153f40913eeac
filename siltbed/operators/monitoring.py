"""Numbers and alerts computed from the run ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.guards import host_allowed
from siltbed.functions.schema import drifted
from siltbed.operators.incremental import key_literal
from siltbed.operators.ledger import OPEN, last_success, latest

# Upper bounds of the duration histogram, in seconds.
DURATION_BUCKETS = (1, 5, 15, 30, 60, 120, 300, 600, 1800)
DASHBOARD_RUNS = 10


def runs_by_status(runs: DataFrame) -> DataFrame:
    return latest(runs).groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def duration_histogram(runs: DataFrame, seconds: Column) -> DataFrame:
    """Cumulative counts per upper bound, from one aggregated row."""
    labels = [*(str(bound) for bound in DURATION_BUCKETS), "+Inf"]
    counts = [F.count_if(seconds <= bound) for bound in DURATION_BUCKETS] + [F.count(seconds)]
    totals = runs.agg(*[c.alias(f"b{i}") for i, c in enumerate(counts)])
    entries = [
        F.struct(F.lit(label).alias("le"), F.col(f"b{i}").alias("runs")) for i, label in enumerate(labels)
    ]
    return totals.select(F.inline(F.array(*entries)))


def rows_total(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.sum("rows_written"), F.lit(0)).alias("rows_total"))


def schema_changes(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if(F.col("schema_changed")).alias("schema_changes"))


def open_runs(current: DataFrame) -> DataFrame:
    """Queued and running runs; expects one row per run (see ``ledger.latest``)."""
    return current.agg(
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status").isin(*OPEN)).alias("open_runs"),
    )


def metrics(runs: DataFrame) -> DataFrame:
    """All single-number metrics in one pass over the runs' newest events."""
    return latest(runs).agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum("rows_written"), F.lit(0)).alias("rows_total"),
        F.count_if(F.col("schema_changed")).alias("schema_changes"),
        F.count_if(F.col("status").isin(*OPEN)).alias("open_runs"),
    )


def dashboard(pipelines: DataFrame, runs: DataFrame) -> DataFrame:
    """Active pipelines, and successes and failures among the ten newest runs."""
    active = pipelines.agg(F.count_if(F.col("is_active")).alias("active_pipelines"))
    recent = (
        latest(runs).orderBy(F.desc("created_at"), F.desc("seq"))
        .limit(DASHBOARD_RUNS)
        .agg(
            F.count_if(F.col("status") == "success").alias("recent_success"),
            F.count_if(F.col("status") == "failed").alias("recent_failed"),
        )
    )
    tiles = ("active_pipelines", "recent_success", "recent_failed")
    return active.unionByName(recent, allowMissingColumns=True).agg(*[F.max(tile).alias(tile) for tile in tiles])


def sla_state(pipelines: DataFrame, runs: DataFrame, now: datetime) -> DataFrame:
    """Live, watched pipelines with ``overdue`` and ``suppressed``. Runs are reduced to one row per pipeline first."""
    moment = key_literal(now.isoformat(), runs.schema["finished_at"].dataType)
    window = F.make_dt_interval(mins=F.col("sla_minutes"))
    watched = pipelines.filter(
        F.col("deleted_at").isNull() & F.col("sla_minutes").isNotNull() & F.col("webhook_url").isNotNull()
    )
    state = watched.join(last_success(runs), "pipeline_id", "left")
    return state.withColumns(
        {
            "checked_at": moment,
            "overdue": F.col("last_success_at").isNull() | (moment - F.col("last_success_at") > window),
            "suppressed": F.coalesce(moment - F.col("sla_notified_at") < window, F.lit(False)),
        }
    )


def sla_breaches(pipelines: DataFrame, runs: DataFrame, now: datetime) -> DataFrame:
    """Breaches to announce now, one payload row each."""
    return (
        sla_state(pipelines, runs, now)
        .filter(F.col("overdue") & ~F.col("suppressed"))
        .select(
            F.lit("sla_breach").alias("event"),
            "pipeline_id",
            "sla_minutes",
            "last_success_at",
            F.col("checked_at").alias("timestamp"),
        )
    )


def notified(pipelines: DataFrame, breaches: DataFrame) -> DataFrame:
    """Pipelines with the notification time moved to the check that just announced them."""
    told = breaches.select("pipeline_id", F.col("timestamp").alias("__told"))
    return (
        pipelines.join(told, "pipeline_id", "left")
        .withColumn("sla_notified_at", F.coalesce("__told", "sla_notified_at"))
        .drop("__told")
    )


def payload(breaches: DataFrame) -> DataFrame:
    return breaches.select("pipeline_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"))


def alerts(runs: DataFrame, allowed_hosts: tuple[str, ...] = ()) -> DataFrame:
    """One row per alert: a failed run, a changed schema, or both, when the pipeline subscribes to it.

    Expects ``status``, ``alert_on``, ``webhook_url``, ``schema_hash`` and ``previous_hash``; an empty subscription
    means failures only. Webhooks outside the host list get no alert.
    """
    wanted = F.when(F.size(F.coalesce("alert_on", F.array())) > 0, F.col("alert_on")).otherwise(
        F.array(F.lit("failed"))
    )
    failed = (F.col("status") == "failed") & F.array_contains(wanted, "failed")
    changed = drifted(F.col("schema_hash"), F.col("previous_hash")) & F.array_contains(wanted, "schema_changed")
    events = F.array_compact(F.array(F.when(failed, F.lit("failed")), F.when(changed, F.lit("schema_changed"))))
    reachable = F.col("webhook_url").isNotNull() & host_allowed(F.col("webhook_url"), allowed_hosts)
    return runs.filter(reachable).withColumn("event", F.explode(events))


ALERT_INPUT = """
    pipeline_id string, job_id string, status string, error string, rows_read bigint, rows_written bigint,
    schema_hash string, previous_hash string, alert_on array<string>, webhook_url string
"""
ALERT_FIELDS = ("event", "pipeline_id", "job_id", "status", "error", "rows_read", "rows_written")


def alert_payloads(raised: DataFrame, now: datetime) -> DataFrame:
    """Address and JSON body of every alert, ready to be sent."""
    body = F.struct(*ALERT_FIELDS, F.lit(now.isoformat()).alias("timestamp"))
    return raised.select("webhook_url", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))
