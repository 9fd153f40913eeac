"""Pipeline registry and purge."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from siltbed.operators import purge, registry
from siltbed.queries.registry import query
from siltbed.queries.views import NOW, PIPELINES_SQL, pipelines, table
from siltbed.session import scratch_path


@query(
    "soft_delete_active",
    f"WITH {PIPELINES_SQL} SELECT pipeline_id, name, created_at FROM pipelines WHERE deleted_at IS NULL",
)
def soft_delete_active(spark, sf_dir):
    return registry.listing(pipelines(spark, sf_dir), "pipeline_id").select("pipeline_id", "name", "created_at")


@query(
    "soft_delete_tombstone",
    f"""WITH {PIPELINES_SQL} SELECT pipeline_id, CASE WHEN deleted_at IS NOT NULL THEN deleted_at
          WHEN pipeline_id IN (SELECT user_id::VARCHAR FROM events WHERE value > 200)
          THEN TIMESTAMP '2024-01-31' END AS deleted_at FROM pipelines""",
)
def soft_delete_tombstone(spark, sf_dir):
    doomed = table(spark, sf_dir, "events").filter("value > 200").select(
        F.col("user_id").cast("string").alias("pipeline_id")
    )
    moment = F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'")
    return registry.tombstone(pipelines(spark, sf_dir), doomed, moment, "pipeline_id").select(
        "pipeline_id", "deleted_at"
    )


@query(
    "soft_delete_cascade",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2024-01-01'
              WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-15' END AS deleted_at
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def soft_delete_cascade(spark, sf_dir):
    """Orders as children of customers; a few are already deleted by themselves."""
    children = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("parent_id"),
        F.when(F.col("o_orderstatus") == "F", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).alias("deleted_at"),
    )
    done = registry.cascade(children, pipelines(spark, sf_dir), "parent_id", "pipeline_id")
    return done.select("o_orderkey", "deleted_at")


@query(
    "duplicate_live_names",
    "SELECT p_name, count(*) AS entries FROM part WHERE p_size <= 25 GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_live_names(spark, sf_dir):
    deleted = F.when(F.col("p_size") > 25, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    return registry.duplicate_names(table(spark, sf_dir, "part").withColumn("deleted_at", deleted), "p_name")


@query(
    "registry_patch",
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey, c_acctbal,
              CASE WHEN c_acctbal > 0 AND c_nationkey < 10 THEN NULL ELSE c_mktsegment END AS c_mktsegment
       FROM customer""",
)
def registry_patch(spark, sf_dir):
    """Patches for customers with a positive balance: some rename, some clear the segment, some change nothing."""
    base = table(spark, sf_dir, "customer")
    changes = base.filter("c_acctbal > 0").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 5000, F.upper("c_name")).alias("c_name"),
        F.lit(None).cast("string").alias("c_mktsegment"),
        F.when(F.col("c_nationkey") < 10, F.array(F.lit("c_mktsegment")))
        .otherwise(F.array().cast("array<string>"))
        .alias("supplied"),
    )
    return registry.patch(base, changes, ["c_name", "c_mktsegment"], ["c_mktsegment"], "c_custkey")


MONTH = "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"


def _landed_by_month(spark, sf_dir) -> str:
    """Orders partitioned by month. ``rebalance`` gathers a month's rows but splits a month that is too large."""
    path = scratch_path(spark, "purge")
    month = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd")
    table(spark, sf_dir, "orders").withColumn("_date", month).hint("rebalance", "_date").write.partitionBy(
        "_date"
    ).parquet(path)
    return path


BEFORE = date(1998, 1, 1)


@query(
    "purge_plan",
    f"SELECT {MONTH} AS partition_date, count(*) AS n_rows FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1",
)
def purge_plan(spark, sf_dir):
    """Planned partitions with the rows they hold."""
    path = _landed_by_month(spark, sf_dir)
    planned = purge.plan(spark, path, BEFORE).select("partition_date").distinct()
    rows = spark.read.parquet(path).groupBy(F.col("_date").cast("date").alias("partition_date")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return planned.join(rows, "partition_date").select(
        F.col("partition_date").cast("string").alias("partition_date"), "n_rows"
    )


@query(
    "purge_apply",
    f"SELECT {MONTH} AS partition_date, count(*) AS n_rows FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1",
)
def purge_apply(spark, sf_dir):
    path = _landed_by_month(spark, sf_dir)
    purge.apply(spark, purge.plan(spark, path, BEFORE))
    return spark.read.parquet(path).groupBy(F.col("_date").cast("string").alias("partition_date")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "purge_run",
    """SELECT 'orders' AS pipeline_id, 'completed' AS status, '1998-01-01' AS before_date,
              count(*) FILTER (o_orderdate < DATE '1998-01-01') > 0 AS anything_deleted,
              count(*) FILTER (o_orderdate >= DATE '1998-01-01') AS rows_left
       FROM orders""",
)
def purge_run(spark, sf_dir):
    """A whole purge: plan, delete, audit; the rows that are left are counted afterwards."""
    path, audit_path = _landed_by_month(spark, sf_dir), scratch_path(spark, "audit")
    purge.run(spark, audit_path, path, NOW, "orders", before=BEFORE)
    left = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_left"))
    return purge.audit(spark.read.parquet(audit_path)).select(
        "pipeline_id",
        "status",
        F.col("before_date").cast("string").alias("before_date"),
        (F.col("files_deleted") > 0).alias("anything_deleted"),
        F.lit(left.first()[0]).cast("bigint").alias("rows_left"),
    )


def _audit_events(spark, sf_dir):
    """Every event opens a purge; clicks, views and purchases also close theirs."""
    e = table(spark, sf_dir, "events")
    closed = F.col("event_type").isin("click", "view", "purchase")
    stages = F.array_compact(F.array(F.lit("in_progress"), F.when(closed, F.lit("completed"))))
    done = F.col("status") == "completed"
    return e.withColumn("status", F.explode(stages)).select(
        (F.col("event_id") * 2 + done.cast("int")).alias("seq"),
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("pipeline_id"),
        "status",
        F.when(done, F.floor("value")).alias("files_deleted"),
        F.col("ts").alias("requested_at"),
    )


AUDIT_SQL = """SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS pipeline_id,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'completed' ELSE 'in_progress' END AS status,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN floor(value)::BIGINT END AS files_deleted,
    ts AS requested_at FROM events"""


@query("purge_audit", f"{AUDIT_SQL} ORDER BY requested_at DESC, id DESC LIMIT 200 OFFSET 10")
def purge_audit(spark, sf_dir):
    return purge.audit(_audit_events(spark, sf_dir), limit=200, offset=10).drop("seq")


@query("purge_audit_state", AUDIT_SQL)
def purge_audit_state(spark, sf_dir):
    return purge.latest(_audit_events(spark, sf_dir), "id").drop("seq")
