import json
import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltbed import storage
from siltbed.operators import ledger, monitoring, purge, quality, registry
from siltbed.operators.sequence import with_previous
from siltbed.plans.spec import RunContext

NOW = datetime(2026, 4, 4, 12, tzinfo=UTC)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def events(spark, *given):
    base = {"status": "success", "triggered_by": "manual", "pipeline_id": "p"}
    blank = dict.fromkeys(f.name for f in spark.createDataFrame([], ledger.LEDGER_SCHEMA).schema.fields)
    full = []
    for i, e in enumerate(given):
        full.append({**blank, **base, "seq": i, "job_id": f"j{i}", "created_at": NOW + timedelta(minutes=i), **e})
    return spark.createDataFrame(full, ledger.LEDGER_SCHEMA)


# ---- previous values


def brute_previous(data):
    last, out = {}, {}
    for key, seq, value in sorted(data, key=lambda r: r[1]):
        out[seq] = last.get(key)
        last[key] = value
    return out


def previous_data(spark):
    rng = random.Random(7)
    keys = ["hot"] * 300 + [f"k{i % 40}" for i in range(500)] + ["once"]
    rng.shuffle(keys)
    keys[5] = keys[50] = keys[500] = None
    return [(key, seq * 3, rng.choice([None, *range(50)])) for seq, key in enumerate(keys)]


@pytest.fixture
def many_parts(spark):
    """Range partitions small enough that a hot key takes many."""
    settings = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_previous_values(spark):
    data = previous_data(spark)
    df = spark.createDataFrame(data, "k string, seq bigint, v int").repartition(7)
    found = with_previous(df, "k", "seq", {"before": "v"})
    assert found.columns == ["k", "seq", "v", "before"]
    assert {r["seq"]: r["before"] for r in found.collect()} == brute_previous(data)


def test_previous_values_on_a_hot_key(spark, many_parts):
    data = previous_data(spark)
    df = spark.createDataFrame(data, "k string, seq bigint, v int").repartition(7)
    found = with_previous(df, "k", "seq", {"before": "v"})
    assert {r["seq"]: r["before"] for r in found.collect()} == brute_previous(data)


def test_a_hot_key_is_spread_over_partitions(spark, many_parts):
    df = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), F.col("id").alias("v"))
    found = with_previous(df, "k", "seq", {"before": "v"})
    assert found.count() == 10_000 and found.filter("before IS DISTINCT FROM nullif(seq, 0) - 1").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and "__part" in plan


def test_previous_row_that_counts(spark, many_parts):
    data = previous_data(spark)
    df = spark.createDataFrame(data, "k string, seq bigint, v int").repartition(7)
    for condition, holds in (("v % 7 = 0", lambda v: v is not None and v % 7 == 0), ("v = 999", lambda v: False)):
        found = with_previous(df, "k", "seq", {"before": "v", "at": "seq"}, F.expr(condition))
        last, wanted = {}, {}
        for key, seq, value in data:
            wanted[seq] = last.get(key, (None, None))
            if holds(value):
                last[key] = (value, seq)
        assert {r["seq"]: (r["before"], r["at"]) for r in found.collect()} == wanted


def test_the_base_of_alerts_is_the_last_accepted_hash(spark):
    runs = events(
        spark,
        {"pipeline_id": "p", "status": "success", "schema_hash": "a"},
        {"pipeline_id": "p", "status": "failed", "schema_hash": "b"},
        {"pipeline_id": "p", "status": "success", "schema_hash": "c", "triggered_by": "backfill"},
        {"pipeline_id": "p", "status": "success", "schema_hash": None},
        {"pipeline_id": "p", "status": "partial_success", "schema_hash": "a"},
        {"pipeline_id": "p", "status": "success", "schema_hash": "d"},
        {"pipeline_id": "q", "status": "success", "schema_hash": "z"},
    )
    found = ledger.with_accepted_hash(runs).orderBy("seq").collect()
    assert [r["previous_hash"] for r in found] == [None, "a", "a", "a", "a", "a", None]


def test_previous_of_nothing(spark):
    df = spark.createDataFrame([], "k string, seq bigint, v int")
    assert with_previous(df, "k", "seq", {"before": "v"}).count() == 0


# ---- ledger


def test_latest_event_per_job(spark):
    runs = events(spark, {"job_id": "a", "status": "queued"}, {"job_id": "a", "status": "running"}, {"job_id": "b", "status": "queued"})
    assert rows(ledger.latest(runs).select("job_id", "status")) == [("a", "running"), ("b", "queued")]
    assert ledger.run(runs, "a").count() == 1


def test_history(spark):
    runs = events(spark, {}, {"status": "failed"}, {"pipeline_id": "q"}, {"status": "failed", "pipeline_id": "q"})

    def ids(**options):
        return [r["seq"] for r in ledger.history(runs, **options).collect()]

    assert ids() == [3, 2, 1, 0]
    assert ids(limit=2, offset=1) == [2, 1]
    assert ids(pipeline="q") == [3, 2] and ids(status="failed") == [3, 1] and ids(pipeline="q", status="failed") == [3]
    for bad in ({"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            ids(**bad)


def test_duration(spark):
    df = spark.createDataFrame([(NOW, NOW + timedelta(microseconds=1_999_999)), (NOW, None), (None, NOW)], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(ledger.duration_ms(F.col("a"), F.col("b"))).collect()] == [1999, None, None]


def test_log_slice(spark):
    lines = spark.createDataFrame([("a", i, f"l{i}") for i in range(4)] + [("b", 0, "x")], "job_id string, line_no int, line string")
    assert rows(ledger.log_slice(lines, 2).select("job_id", "line", "next_offset")) == [
        ("a", "l2", 4), ("a", "l3", 4), ("b", None, 2)]
    assert ledger.log_slice(lines, 0, "b").first()["next_offset"] == 1


def test_watermarks_skip_backfills_failures_and_ad_hoc_runs(spark):
    runs = events(
        spark,
        {"watermark": "w1"},
        {"watermark": "w2", "triggered_by": "backfill"},
        {"watermark": "w3", "status": "failed"},
        {"watermark": "w4", "pipeline_id": None},
        {"watermark": "w5", "pipeline_id": "q", "status": "partial_success", "triggered_by": None},
    )
    assert rows(ledger.watermarks(runs)) == [("p", "w1"), ("q", "w5")]


def test_lineage(spark):
    edge = {"source_connection_id": "c", "destination_path": "bronze/orders/"}
    runs = events(spark, edge, edge, {**edge, "pipeline_id": "q"}, {})
    assert rows(ledger.lineage(runs)) == [("c", "p", "bronze/orders/", 2), ("c", "q", "bronze/orders/", 1)]


# ---- gates


@pytest.mark.parametrize(("count", "ok"), [(10, True), (100, True), (5, False)])
def test_min_rows(count, ok):
    if ok:
        quality.check_gates(count, 10, None, None)
    else:
        with pytest.raises(quality.GateError):
            quality.check_gates(count, 10, None, None)


@pytest.mark.parametrize(("count", "previous", "ok"), [(85, 100, True), (80, 100, True), (70, 100, False), (1, None, True), (1, 0, True)])
def test_row_drop(spark, count, previous, ok):
    df = spark.createDataFrame([(count, previous)], "r bigint, p bigint")
    assert df.select(quality.row_drop_violated(F.col("r"), F.col("p"), F.lit(20.0))).first()[0] is not ok
    if ok:
        quality.check_gates(count, None, 20, previous)
    else:
        with pytest.raises(quality.GateError):
            quality.check_gates(count, None, 20, previous)


def test_status_resolution(spark):
    df = spark.createDataFrame([(3, 3, 0, None), (3, 2, 0, None), (3, 3, 1, None), (3, 2, 1, None), (3, 3, 0, "x"), (None, None, 0, "t")],
                               "r int, w int, f int, e string")
    status = quality.resolved_status(F.col("r"), F.col("w"), F.col("f"), F.col("e"))
    assert [r[0] for r in df.select(status).collect()] == ["success", "failed", "partial_success", "failed", "failed", "failed"]


# ---- freshness and alerts

PIPELINES = "pipeline_id string, webhook_url string, sla_minutes int, sla_notified_at timestamp, deleted_at timestamp"


@pytest.mark.parametrize(
    ("last", "notified", "breached"),
    [
        (None, None, True),
        (timedelta(hours=2), None, True),
        (timedelta(minutes=30), None, False),
        (timedelta(minutes=60), None, False),
        (timedelta(hours=3), timedelta(minutes=15), False),
        (timedelta(hours=3), timedelta(minutes=60), True),
    ],
)
def test_sla(spark, last, notified, breached):
    pipelines = spark.createDataFrame([("p", "u", 60, NOW - notified if notified else None, None)], PIPELINES)
    runs = events(spark, *([{"finished_at": NOW - last}] if last else []), {"status": "failed", "finished_at": NOW})
    found = monitoring.sla_breaches(pipelines, runs, NOW)
    assert found.count() == int(breached)
    if breached:
        assert found.columns == ["event", "pipeline_id", "sla_minutes", "last_success_at", "timestamp"]
        assert '"last_success_at":' in monitoring.payload(found).first()["payload"]
        told = monitoring.notified(pipelines, found)
        assert monitoring.sla_breaches(told, runs, NOW + timedelta(minutes=5)).count() == 0


def test_sla_needs_webhook_limit_and_a_live_pipeline(spark):
    pipelines = spark.createDataFrame([("a", None, 60, None, None), ("b", "u", None, None, None), ("c", "u", 60, None, NOW)], PIPELINES)
    assert monitoring.sla_breaches(pipelines, events(spark, {}), NOW).count() == 0


@pytest.mark.parametrize(
    ("status", "alert_on", "old", "expected"),
    [
        ("failed", None, None, ["failed"]),
        ("failed", [], None, ["failed"]),
        ("success", ["failed"], "x", []),
        ("success", ["schema_changed"], "x", ["schema_changed"]),
        ("failed", ["failed", "schema_changed"], "x", ["failed", "schema_changed"]),
        ("success", ["schema_changed"], None, []),
        ("failed", ["schema_changed"], "h", []),
    ],
)
def test_alerts(spark, status, alert_on, old, expected):
    df = spark.createDataFrame([(status, alert_on, "u", "h", old), (status, alert_on, None, "h", old)],
                               "status string, alert_on array<string>, webhook_url string, schema_hash string, previous_hash string")
    assert sorted(r["event"] for r in monitoring.alerts(df).collect()) == expected


def test_alert_payload_and_blocked_hosts(spark):
    df = spark.createDataFrame(
        [("p", "j", "failed", "boom", 1, None, None, f"https://{host}/x", "h", None) for host in ("ok.example.com", "evil.org")],
        "pipeline_id string, job_id string, status string, error string, rows_read int, rows_written int, alert_on array<string>, "
        "webhook_url string, schema_hash string, previous_hash string",
    )
    found = monitoring.alert_payloads(monitoring.alerts(df, ("example.com",)), NOW).collect()
    assert [r["webhook_url"] for r in found] == ["https://ok.example.com/x"]
    assert json.loads(found[0]["payload"]) == {
        "event": "failed", "pipeline_id": "p", "job_id": "j", "status": "failed", "error": "boom", "rows_read": 1,
        "rows_written": None, "timestamp": NOW.isoformat(),
    }


def test_metrics_and_dashboard(spark):
    runs = events(spark, *[{"status": "failed", "rows_written": None}] * 3, *[{"rows_written": 5, "schema_changed": True}] * 12, {"status": "queued"})
    assert tuple(monitoring.metrics(runs).first()) == (16, 60, 12, 1)
    assert tuple(monitoring.rows_total(events(spark)).first()) == (0,)
    pipelines = spark.createDataFrame([(True,), (False,), (True,)], "is_active boolean")
    assert tuple(monitoring.dashboard(pipelines, runs).first()) == (2, 9, 0)


def test_histogram(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (4.0,), (2000.0,), (None,)], "s double")
    found = dict(monitoring.duration_histogram(df, F.col("s")).collect())
    assert found == {"1": 2, "5": 3, "15": 3, "30": 3, "60": 3, "120": 3, "300": 3, "600": 3, "1800": 3, "+Inf": 4}


# ---- registry


def test_registry(spark):
    base = spark.createDataFrame(
        [("1", "a", "x", NOW, None), ("2", "a", "y", NOW - timedelta(days=1), None), ("3", "b", "z", NOW, NOW), ("4", "b", "w", NOW, None)],
        "id string, name string, note string, created_at timestamp, deleted_at timestamp",
    )
    assert [r["id"] for r in registry.listing(base).collect()] == ["2", "1", "4"]
    assert rows(registry.duplicate_names(base)) == [("a", 2)]
    gone = registry.tombstone(base, spark.createDataFrame([("1",), ("3",), ("1",)], "id string"), NOW + timedelta(days=1))
    assert rows(gone.filter("deleted_at IS NOT NULL").select("id", F.col("deleted_at").cast("date"))) == [
        ("1", date(2026, 4, 5)), ("3", date(2026, 4, 4)),
    ]
    children = spark.createDataFrame([("s1", "1", None), ("s2", "2", None), ("s3", "1", NOW)], "id string, parent string, deleted_at timestamp")
    after = registry.cascade(children, gone, "parent")
    assert rows(registry.live(after).select("id")) == [("s2",)] and after.columns == ["parent", "id", "deleted_at"]
    changes = spark.createDataFrame([("1", "n", None, []), ("2", None, None, ["note"]), ("4", None, "v", ["note"])],
                                    "id string, name string, note string, supplied array<string>")
    patched = registry.patch(base, changes, ["name", "note"], ["note"])
    assert rows(patched.select("id", "name", "note")) == [("1", "n", "x"), ("2", "a", None), ("3", "b", "z"), ("4", "b", "v")]


# ---- purge


@pytest.fixture
def dated(spark, folder):
    df = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3}") for i in range(9)], "id bigint, _date string")
    df.repartition(1).write.partitionBy("_date").parquet(folder)
    spark.range(2).repartition(1).write.mode("append").parquet(f"{folder}/undated")
    return folder


def test_purge_plan(spark, dated):
    assert purge.plan(spark, dated).count() == 4
    old = purge.plan(spark, dated, before=date(2024, 1, 3))
    assert rows(old.select("partition_date").distinct()) == [(date(2024, 1, 1),), (date(2024, 1, 2),)]
    assert purge.plan(spark, dated, partition_filter="_date=2024-01-02").count() == 1
    assert purge.plan(spark, dated, partition_filter="undated").count() == 1
    assert purge.plan(spark, dated, date(2024, 1, 2), "undated").count() == 0
    assert purge.plan(spark, f"{dated}/missing").count() == 0
    # The filter does not match in the part of the path above the dataset.
    assert purge.plan(spark, dated, partition_filter=dated.strip("/").split("/")[-1]).count() == 0
    planned = purge.totals(old).first()
    assert planned["estimated_files"] == 2 and planned["bytes"] == sum(e.length for e in storage.data_files(spark, dated) if "01-03" not in e.relative and "undated" not in e.relative)


def test_purge_apply_and_repeat(spark, dated, folder):
    manifest = f"{folder}-manifest"
    size = purge.totals(purge.plan(spark, dated, date(2024, 1, 3))).first()["bytes"]
    done = purge.apply(spark, purge.plan(spark, dated, date(2024, 1, 3)), manifest)
    assert done == purge.PurgeResult(2, size)
    assert purge.apply_manifest(spark, manifest) == done
    assert purge.plan(spark, dated).count() == 2
    assert purge.plan(spark, f"{dated}/{{date}}").count() == 0  # these folders are partitions, not that template's


def test_purge_deletes_whole_folders(spark, folder, monkeypatch):
    spark.range(1000).selectExpr("id", "concat('2024-01-', lpad(1 + id % 10, 2, '0')) AS _date").repartition(100, "id").write.partitionBy("_date").parquet(folder)
    spark.range(100).repartition(100).write.parquet(f"{folder}/_date=2024-02-01/_run=a")
    kept = purge.plan(spark, folder, partition_filter="_run=a").count()
    many = purge.plan(spark, folder, date(2024, 1, 11))
    n = many.count()
    assert n > 500
    calls = []
    real_tree, real_files = storage.delete_tree, storage.delete_files
    monkeypatch.setattr(storage, "delete_tree", lambda s, path: (calls.append(path), real_tree(s, path))[1])
    monkeypatch.setattr(storage, "delete_files", lambda s, paths: real_files(s, [(calls.append(p), p)[1] for p in paths]))
    assert purge.apply(spark, many).files_deleted == n
    assert len([c for c in calls if "_date=" in c]) == 10
    assert purge.plan(spark, folder).count() == kept
    # A filter that splits a folder leaves the rest of it alone.
    some = purge.plan(spark, folder, partition_filter="part-0001")
    wanted = some.count()
    assert 0 < wanted < kept and purge.apply(spark, some).files_deleted == wanted
    assert purge.plan(spark, folder).count() == kept - wanted


def test_purge_run_is_audited(spark, dated, folder):
    path = f"{folder}-audit"
    done = purge.run(spark, path, dated, NOW, "p", "someone", partition_filter="_date=2024-01-02")
    found = purge.audit(spark.read.parquet(path)).collect()
    assert [(r["status"], r["files_deleted"], r["requested_by"]) for r in found] == [("completed", 1, "someone")]
    assert done.files_deleted == 1 and spark.read.parquet(path).count() == 2


def test_purge_audit(spark):
    opened = {"pipeline_id": "p", "requested_by": "u", "before_date": date(2024, 1, 3), "partition_filter": None}
    given = [(1, "a", "in_progress", None, NOW), (2, "b", "in_progress", None, NOW + timedelta(1)), (3, "a", "completed", 2, NOW)]
    df = spark.createDataFrame(
        [{**opened, "seq": s, "id": i, "status": st, "files_deleted": f, "bytes_deleted": None, "requested_at": t, "completed_at": None}
         for s, i, st, f, t in given], purge.AUDIT_SCHEMA)
    assert [(r["id"], r["status"]) for r in purge.audit(df).collect()] == [("b", "in_progress"), ("a", "completed")]
    assert purge.audit_event(df, "a").first()["files_deleted"] == 2
    with pytest.raises(ValueError):
        purge.audit(df, limit=201)


def test_run_context_ids_are_unique():
    assert RunContext().run_id != RunContext().run_id


def test_purge_by_template_leaves_other_pipelines(spark, folder):
    from datetime import date

    from siltbed.operators import purge
    from tests.test_sources import put

    for name in ("2024-01-01/orders", "2024-01-02/orders", "2024-01-01/customers", "orders-2024-01-01", "orders/2024-01-01"):
        put(spark, f"{folder}/bronze/{name}/a.parquet", "x")

    def planned(template, before=None):
        found = purge.plan(spark, f"{folder}/bronze/{template}", before).collect()
        return sorted((r.relative.removesuffix("/a.parquet"), str(r.partition_date)) for r in found)

    assert planned("{date}/orders") == [("2024-01-01/orders", "2024-01-01"), ("2024-01-02/orders", "2024-01-02")]
    assert planned("{date}/orders", date(2024, 1, 2)) == [("2024-01-01/orders", "2024-01-01")]
    assert planned("orders-{date}") == [("orders-2024-01-01", "2024-01-01")]
    assert planned("orders/{date}", date(2024, 1, 2)) == [("2024-01-01", "2024-01-01")]
