"""Run ledger, metrics, freshness, alerts and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltbed.operators import ledger, monitoring, quality
from siltbed.queries.registry import query
from siltbed.queries.views import GOOD_SQL, NOW, PIPELINES_SQL, RUNS_SQL, pipelines, runs, table

LATEST_SQL = f"""{RUNS_SQL}, latest AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS n FROM runs)
  WHERE n = 1)"""


@query("run_ledger_latest", f"WITH {LATEST_SQL} SELECT job_id, seq, pipeline_id, status, rows_read, finished_at FROM latest")
def run_ledger_latest(spark, sf_dir):
    return ledger.latest(
        runs(spark, sf_dir).select("job_id", "seq", "pipeline_id", "status", "rows_read", "finished_at")
    )


HISTORY_COLUMNS = ["seq", "job_id", "pipeline_id", "status", "rows_read", "created_at"]
HISTORY_SQL = f"WITH {LATEST_SQL} SELECT {', '.join(HISTORY_COLUMNS)} FROM latest"
NEWEST_SQL = "ORDER BY created_at DESC, seq DESC"


@query("run_history_page", f"{HISTORY_SQL} {NEWEST_SQL} LIMIT 50 OFFSET 100")
def run_history_page(spark, sf_dir):
    return ledger.history(runs(spark, sf_dir).select(HISTORY_COLUMNS), limit=50, offset=100)


@query("run_history_pipeline", f"{HISTORY_SQL} WHERE pipeline_id = '3' {NEWEST_SQL} LIMIT 500")
def run_history_pipeline(spark, sf_dir):
    return ledger.history(runs(spark, sf_dir).select(HISTORY_COLUMNS), pipeline="3", limit=500)


@query("run_history_status", f"{HISTORY_SQL} WHERE status = 'failed' {NEWEST_SQL} LIMIT 500 OFFSET 20")
def run_history_status(spark, sf_dir):
    return ledger.history(runs(spark, sf_dir).select(HISTORY_COLUMNS), status="failed", limit=500, offset=20)


@query(
    "run_duration_ms",
    """SELECT event_id AS seq, CASE WHEN event_type <> 'view' THEN round(value * 1000)::BIGINT END AS duration_ms
       FROM events""",
)
def run_duration_ms(spark, sf_dir):
    return runs(spark, sf_dir).select(
        "seq", ledger.duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms")
    )


@query(
    "log_slice",
    """WITH ends AS (
         SELECT conv_id, 2 + count(*) FILTER (turn >= 2) AS next_offset FROM conversations GROUP BY 1)
       SELECT conv_id::VARCHAR AS job_id, turn AS line_no, text AS line, next_offset
       FROM ends LEFT JOIN (SELECT * FROM conversations WHERE turn >= 2) USING (conv_id)""",
)
def log_slice(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("job_id"), F.col("turn").alias("line_no"), F.col("text").alias("line")
    )
    return ledger.log_slice(lines, 2)


@query(
    "last_success_per_pipeline",
    f"WITH {RUNS_SQL} SELECT pipeline_id, max(finished_at) AS last_success_at FROM runs WHERE {GOOD_SQL} GROUP BY 1",
)
def last_success_per_pipeline(spark, sf_dir):
    return ledger.last_success(runs(spark, sf_dir))


@query(
    "watermark_registry",
    f"""WITH {RUNS_SQL} SELECT pipeline_id, arg_max(watermark, seq) AS last_watermark
        FROM runs WHERE {GOOD_SQL} AND triggered_by <> 'backfill' GROUP BY 1""",
)
def watermark_registry(spark, sf_dir):
    return ledger.watermarks(runs(spark, sf_dir))


SLA_SQL = f"""{RUNS_SQL}, {PIPELINES_SQL}, last AS (
  SELECT pipeline_id, max(finished_at) AS last_success_at FROM runs WHERE {GOOD_SQL} GROUP BY 1),
state AS (
  SELECT p.*, l.last_success_at, TIMESTAMP '2024-01-31' AS checked_at,
         l.last_success_at IS NULL
           OR l.last_success_at < TIMESTAMP '2024-01-31' - to_minutes(p.sla_minutes) AS overdue,
         coalesce(p.sla_notified_at > TIMESTAMP '2024-01-31' - to_minutes(p.sla_minutes), false) AS suppressed
  FROM pipelines p LEFT JOIN last l USING (pipeline_id)
  WHERE p.deleted_at IS NULL AND p.sla_minutes IS NOT NULL AND p.webhook_url IS NOT NULL)"""


@query(
    "sla_breach",
    f"""WITH {SLA_SQL}
        SELECT 'sla_breach' AS event, pipeline_id, sla_minutes, last_success_at, checked_at AS timestamp
        FROM state WHERE overdue AND NOT suppressed""",
)
def sla_breach(spark, sf_dir):
    return monitoring.sla_breaches(pipelines(spark, sf_dir), runs(spark, sf_dir), NOW)


@query(
    "sla_suppressed",
    f"WITH {SLA_SQL} SELECT pipeline_id, sla_minutes, sla_notified_at FROM state WHERE overdue AND suppressed",
)
def sla_suppressed(spark, sf_dir):
    state = monitoring.sla_state(pipelines(spark, sf_dir), runs(spark, sf_dir), NOW)
    return state.filter("overdue AND suppressed").select("pipeline_id", "sla_minutes", "sla_notified_at")


@query(
    "sla_notified",
    f"""WITH {SLA_SQL}, told AS (SELECT pipeline_id FROM state WHERE overdue AND NOT suppressed)
        SELECT p.pipeline_id, CASE WHEN t.pipeline_id IS NOT NULL THEN TIMESTAMP '2024-01-31'
                                   ELSE p.sla_notified_at END AS sla_notified_at
        FROM pipelines p LEFT JOIN told t USING (pipeline_id)""",
)
def sla_notified(spark, sf_dir):
    watched = pipelines(spark, sf_dir)
    breaches = monitoring.sla_breaches(watched, runs(spark, sf_dir), NOW)
    return monitoring.notified(watched, breaches).select("pipeline_id", "sla_notified_at")


@query("metrics_runs_by_status", f"WITH {LATEST_SQL} SELECT status, count(*) AS runs FROM latest GROUP BY 1")
def metrics_runs_by_status(spark, sf_dir):
    return monitoring.runs_by_status(runs(spark, sf_dir))


@query(
    "metrics_duration_histogram",
    """SELECT le, count(*) FILTER (value <= bound) AS runs
       FROM events, (VALUES ('1', 1.0), ('5', 5.0), ('15', 15.0), ('30', 30.0), ('60', 60.0), ('120', 120.0),
                            ('300', 300.0), ('600', 600.0), ('1800', 1800.0), ('+Inf', 1e300)) b(le, bound)
       GROUP BY le""",
)
def metrics_duration_histogram(spark, sf_dir):
    return monitoring.duration_histogram(runs(spark, sf_dir), F.col("value"))


@query("metrics_rows_total", f"WITH {RUNS_SQL} SELECT sum(rows_written)::BIGINT AS rows_total FROM runs")
def metrics_rows_total(spark, sf_dir):
    return monitoring.rows_total(runs(spark, sf_dir))


@query(
    "metrics_schema_changes",
    f"""WITH {RUNS_SQL}, known AS (
          SELECT schema_hash <> lag(schema_hash) OVER (PARTITION BY pipeline_id ORDER BY seq) AS changed
          FROM runs WHERE {GOOD_SQL} AND triggered_by <> 'backfill')
        SELECT count(*) FILTER (changed) AS schema_changes FROM known""",
)
def metrics_schema_changes(spark, sf_dir):
    return monitoring.schema_changes(ledger.schema_drift(runs(spark, sf_dir)))


@query(
    "metrics_open_runs",
    f"""WITH {LATEST_SQL}
        SELECT count(*) FILTER (event_type = 'click') AS queued, count(*) FILTER (event_type = 'view') AS running,
               count(*) FILTER (event_type IN ('click', 'view')) AS open_runs
        FROM latest""",
)
def metrics_open_runs(spark, sf_dir):
    """Jobs whose newest event is a click count as queued, those whose newest is a view as running."""
    kind = F.col("event_type")
    events = runs(spark, sf_dir).select(
        "job_id", "seq", F.when(kind == "click", "queued").when(kind == "view", "running").otherwise("success").alias("status")
    )
    return monitoring.open_runs(ledger.latest(events))


@query(
    "dashboard_counts",
    f"""WITH {LATEST_SQL}, {PIPELINES_SQL}, recent AS (SELECT status FROM latest {NEWEST_SQL} LIMIT 10)
        SELECT (SELECT count(*) FILTER (is_active) FROM pipelines) AS active_pipelines,
               (SELECT count(*) FILTER (status = 'success') FROM recent) AS recent_success,
               (SELECT count(*) FILTER (status = 'failed') FROM recent) AS recent_failed""",
)
def dashboard_counts(spark, sf_dir):
    return monitoring.dashboard(pipelines(spark, sf_dir), runs(spark, sf_dir))


@query(
    "lineage_edges",
    f"""WITH {LATEST_SQL} SELECT source_connection_id, pipeline_id, destination_path, count(*) AS runs
        FROM latest GROUP BY 1, 2, 3""",
)
def lineage_edges(spark, sf_dir):
    return ledger.lineage(runs(spark, sf_dir))


@query("runs_by_trigger", f"WITH {LATEST_SQL} SELECT triggered_by, count(*) AS runs FROM latest GROUP BY 1")
def runs_by_trigger(spark, sf_dir):
    return ledger.by_trigger(runs(spark, sf_dir))


@query(
    "alert_events",
    f"""WITH {RUNS_SQL}, {PIPELINES_SQL}, seen AS (
          SELECT *, last_value(CASE WHEN {GOOD_SQL} AND triggered_by <> 'backfill' THEN schema_hash END IGNORE NULLS) OVER (
              PARTITION BY pipeline_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_hash
          FROM runs),
        joined AS (
          SELECT s.seq, s.pipeline_id, s.status, s.rows_read, s.schema_hash, s.previous_hash,
                 coalesce(p.alert_on, ['failed']) AS wanted
          FROM seen s JOIN pipelines p USING (pipeline_id) WHERE p.webhook_url IS NOT NULL)
        SELECT 'failed' AS event, seq, pipeline_id, status, rows_read FROM joined
        WHERE status = 'failed' AND list_contains(wanted, 'failed')
        UNION ALL
        SELECT 'schema_changed', seq, pipeline_id, status, rows_read FROM joined
        WHERE schema_hash <> previous_hash AND list_contains(wanted, 'schema_changed')""",
)
def alert_events(spark, sf_dir):
    subscribed = ledger.with_accepted_hash(runs(spark, sf_dir)).join(
        pipelines(spark, sf_dir).select("pipeline_id", "webhook_url", "alert_on"), "pipeline_id"
    )
    return monitoring.alerts(subscribed).select("event", "seq", "pipeline_id", "status", "rows_read")


@query(
    "run_status_resolution",
    """SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'failed'
              WHEN event_type = 'purchase' AND value > 100 THEN 'failed'
              WHEN event_type = 'signup' THEN 'partial_success' ELSE 'success' END AS status
       FROM events""",
)
def run_status_resolution(spark, sf_dir):
    kind, read = F.col("event_type"), F.col("rows_read")
    lost = F.when((kind == "purchase") & (F.col("value") > 100), 1).otherwise(0)
    status = quality.resolved_status(
        read, read - lost, F.when(kind == "signup", 2).otherwise(0), F.when(kind == "error", "lost connection")
    )
    return runs(spark, sf_dir).select("seq", status.alias("status"))


@query(
    "dq_min_rows",
    f"WITH {RUNS_SQL} SELECT seq, rows_read, rows_read < 10 AS violated FROM runs",
)
def dq_min_rows(spark, sf_dir):
    return runs(spark, sf_dir).select(
        "seq", "rows_read", quality.min_rows_violated(F.col("rows_read"), F.lit(10)).alias("violated")
    )


@query(
    "dq_row_drop",
    f"""WITH {RUNS_SQL}, seen AS (
          SELECT *, lag(rows_read) OVER (PARTITION BY pipeline_id ORDER BY seq) AS previous_rows
          FROM runs WHERE {GOOD_SQL} AND triggered_by <> 'backfill')
        SELECT seq, pipeline_id, rows_read, previous_rows,
               coalesce((1.0::DOUBLE - rows_read::DOUBLE / nullif(previous_rows, 0)::DOUBLE) * 100.0::DOUBLE > 20.0,
                        false) AS violated
        FROM seen""",
)
def dq_row_drop(spark, sf_dir):
    return ledger.row_drops(runs(spark, sf_dir), 20.0).select(
        "seq", "pipeline_id", "rows_read", "previous_rows", "violated"
    )
