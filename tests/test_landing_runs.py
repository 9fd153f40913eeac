import sys
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from siltbed import extensions, storage
from siltbed.operators import ledger
from siltbed.plans import runner
from siltbed.plans.runner import run_extract, run_pipeline
from siltbed.plans.spec import BackfillWindow, PipelineSpec, RunContext, SpecError
from siltbed.sinks import parquet
from siltbed.streaming.landing import BatchRules, StreamOptions, land_stream, read_stream

T0 = datetime(2024, 4, 3, 12, tzinfo=UTC)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


class Lab:
    """A pipeline with a source that tests can change between runs."""

    def __init__(self, spark, folder):
        self.spark, self.root, self.ledger_path = spark, f"{folder}/", f"{folder}/ledger"
        self.data, self.minutes = None, 0
        extensions.source("lab", lambda s, spec, ctx: self.data)

    def run(self, window=None, trigger="manual", **changes):
        self.minutes += 10
        spec = PipelineSpec(**{"pipeline_id": "p", "destination": "bronze/p", "source": "lab", **changes})
        ctx = RunContext(run_ts=T0 + timedelta(minutes=self.minutes), triggered_by=trigger)
        return run_pipeline(self.spark, spec, ctx, self.ledger_path, self.root, window)

    def set(self, values, ddl="id bigint"):
        self.data = self.spark.createDataFrame(values, ddl)

    @property
    def landed(self):
        return parquet.read_landed(self.spark, f"{self.root}bronze/p")

    @property
    def events(self):
        return ledger.read(self.spark, self.ledger_path)


@pytest.fixture
def lab(spark, folder):
    return Lab(spark, folder)


def test_full_refresh_replaces(lab):
    lab.set([(1,), (2,)])
    assert lab.run().status == "success"
    lab.set([(3,)])
    assert lab.run().status == "success"
    assert rows(lab.landed) == [(3,)]
    assert not storage.exists(lab.spark, f"{lab.root}bronze/p/_staging/x")
    assert list(storage.iter_files(lab.spark, f"{lab.root}bronze/p/_staging")) == []


def test_full_refresh_with_an_empty_result_leaves_an_empty_dataset(lab):
    lab.set([(1,)])
    lab.run()
    lab.set([])
    result = lab.run()
    assert (result.status, result.rows_read) == ("success", 0)
    assert lab.landed.count() == 0 and lab.landed.columns == ["id"]


def test_incremental_appends_after_the_run_start(lab):
    options = {"extraction_mode": "incremental", "incremental_key": "t"}
    lab.set([(1, T0 - timedelta(days=1))], "id bigint, t timestamp")
    assert lab.run(**options).rows_read == 1
    lab.set([(1, T0 - timedelta(days=1)), (2, T0 + timedelta(minutes=11))], "id bigint, t timestamp")
    assert lab.run(**options).rows_read == 1
    assert rows(lab.landed.select("id")) == [(1,), (2,)]
    assert lab.run(**options).rows_read == 0


def test_max_key_watermark(lab):
    options = {"extraction_mode": "incremental", "incremental_key": "t", "watermark_from": "max_key"}
    lab.set([(1, datetime(2020, 1, 1)), (2, datetime(2020, 1, 2, 3, 4, 5, 678900))], "id bigint, t timestamp_ntz")
    assert lab.run(**options).watermark == "2020-01-02T03:04:05.678900"
    lab.set([(3, datetime(2020, 1, 2, 3, 4, 5, 678900)), (4, datetime(2020, 1, 2, 3, 4, 5, 678901))], "id bigint, t timestamp_ntz")
    assert lab.run(**options).rows_read == 1
    lab.set([], "id bigint, t timestamp_ntz")
    assert lab.run(**options).watermark == "2020-01-02T03:04:05.678901"


def test_backfill_appends_and_leaves_the_watermark(lab):
    options = {"extraction_mode": "incremental", "incremental_key": "t"}
    lab.set([(1, T0)], "id bigint, t timestamp")
    first = lab.run(**options)
    lab.set([(2, datetime(2023, 1, 1, tzinfo=UTC)), (3, datetime(2023, 2, 1, tzinfo=UTC))], "id bigint, t timestamp")
    window = BackfillWindow("2023-01-01", "2023-02-01")
    done = lab.run(window, **options)
    assert (done.status, done.rows_read, done.watermark) == ("success", 1, None)
    assert rows(ledger.watermarks(lab.events)) == [("p", first.watermark)]
    assert rows(lab.landed.select("id")) == [(1,), (2,)]
    assert rows(ledger.by_trigger(lab.events)) == [("backfill", 1), ("manual", 1)]
    with pytest.raises(SpecError):
        lab.run(window)


def test_backfill_of_a_full_refresh_pipeline_does_not_replace(lab):
    lab.set([(1, T0)], "id bigint, t timestamp")
    lab.run(incremental_key="t")
    lab.run(BackfillWindow("2024-01-01", "2025-01-01"), incremental_key="t")
    assert lab.landed.count() == 2


def test_ingest_date_partition(lab):
    lab.set([(1,), (2,)])
    lab.run(partition_by="ingest_date")
    assert rows(lab.landed) == [(1, "2024-04-03"), (2, "2024-04-03")]
    assert dict(lab.landed.dtypes)["_date"] == "string"
    lab.minutes += 24 * 60
    lab.set([(3,)])
    lab.run(partition_by="ingest_date")
    assert rows(lab.landed) == [(1, "2024-04-03"), (2, "2024-04-03"), (3, "2024-04-04")]
    lab.set([(4,)])
    lab.run(partition_by="ingest_date")
    assert rows(lab.landed) == [(1, "2024-04-03"), (2, "2024-04-03"), (4, "2024-04-04")]


@pytest.mark.parametrize("codec", ["snappy", "gzip", "none"])
def test_compression(lab, codec):
    lab.set([(1,)])
    lab.run(compression=codec)
    names = [e.relative for e in storage.data_files(lab.spark, f"{lab.root}bronze/p")]
    ending = {"snappy": ".snappy.parquet", "gzip": ".gz.parquet", "none": ".parquet"}[codec]
    assert names and all(n.endswith(ending) for n in names)


def test_rows_can_be_spread_over_tasks(lab):
    lab.set([(i,) for i in range(100)])
    lab.data = lab.data.coalesce(1)
    assert lab.run(write_tasks=3).rows_written == 100
    assert len(list(storage.data_files(lab.spark, f"{lab.root}bronze/p"))) == 3


def test_masking_after_hash_and_contract(lab):
    lab.set([("a", 1.5)], "email string, score double")
    expected = [{"name": "email", "type": "string"}, {"name": "score", "type": "double"}]
    result = lab.run(pii_columns={"email": "sha256", "score": "redact", "gone": "sha256"}, expected_schema=expected)
    assert result.schema_hash == "63a1e22861909f71c21e765847a0d15d79d6631f044a1cd7ecf7deb267689127"
    assert rows(lab.landed)[0][1] is None and len(rows(lab.landed)[0][0]) == 64


@pytest.mark.parametrize(
    ("changes", "text"),
    [
        ({"min_rows_expected": 10}, "at least 10"),
        ({"expected_schema": [{"name": "nope", "type": "int64"}]}, "missing"),
        ({"expected_schema": [{"name": "id", "type": "string"}]}, "wrong types"),
    ],
)
def test_failed_checks_leave_the_target(lab, changes, text):
    lab.set([(1,), (2,)])
    lab.run()
    lab.set([(9,)])
    result = lab.run(**changes)
    assert result.status == "failed" and text in result.error
    assert rows(lab.landed) == [(1,), (2,)]
    assert list(storage.iter_files(lab.spark, f"{lab.root}bronze/p/_staging")) == []
    assert rows(ledger.history(lab.events, status="failed").select("pipeline_id")) == [("p",)]


def test_row_drop_gate_uses_the_last_good_run(lab):
    lab.set([(i,) for i in range(100)])
    lab.run(max_rows_drop_pct=20)
    lab.set([(i,) for i in range(70)])
    assert "30.0%" in lab.run(max_rows_drop_pct=20).error
    lab.set([(i,) for i in range(85)])
    assert lab.run(max_rows_drop_pct=20).status == "success"


def test_failing_source_is_recorded(lab):
    lab.spark.udf.register("boom", lambda x: 1 / 0, "int")
    lab.data = lab.spark.range(3).selectExpr("boom(id) AS x")
    result = lab.run()
    assert result.status == "failed" and result.error
    assert ledger.latest(lab.events).count() == 1 and not list(storage.data_files(lab.spark, f"{lab.root}bronze/p"))


def test_schema_change_is_flagged_but_does_not_stop(lab):
    lab.set([(1,)])
    assert lab.run().schema_changed is False
    lab.set([(1, "a")], "id bigint, name string")
    result = lab.run()
    assert (result.status, result.schema_changed) == ("success", True)
    registry = ledger.schema_registry(lab.events).first()
    assert registry["last_schema_hash"] == result.schema_hash
    assert [d["name"] for d in registry["last_schema"]] == ["id", "name"]


def test_promotion_failure_fails_the_run_and_keeps_the_watermark(lab, monkeypatch):
    lab.set([(1,)])
    first = lab.run()
    monkeypatch.setattr(runner.parquet, "promote", lambda *a, **k: (_ for _ in ()).throw(OSError("store is down")))
    result = lab.run()
    assert result.status == "failed" and "store is down" in result.error
    assert rows(ledger.watermarks(lab.events)) == [("p", first.watermark)]


def test_count_mismatch_fails(lab, monkeypatch):
    real = parquet.stage

    def short(*args):
        staged = real(*args)
        return parquet.StagedWrite(staged.path, staged.run_id, staged.rows_read, staged.rows_written - 1)

    monkeypatch.setattr(runner.parquet, "stage", short)
    lab.set([(1,), (2,), (3,)])
    result = lab.run()
    assert result.status == "failed" and "3 rows read but 2 written" in result.error
    assert not list(storage.data_files(lab.spark, f"{lab.root}bronze/p"))


def test_partial_success_from_files(lab, folder):
    from tests.test_sources import put

    put(lab.spark, f"{folder}/in/a.json", '{"id": 1}\n')
    put(lab.spark, f"{folder}/in/b.json", '{"id"\n')
    options = {"paths": (f"{folder}/in",), "parser": "json", "schema": "id bigint"}
    result = lab.run(source="files", source_options=options)
    assert result.status == "partial_success" and len(result.failed_files) == 1 and result.rows_written == 1
    assert ledger.watermarks(lab.events).count() == 1


def test_files_are_landed_once_across_runs(lab, folder):
    from tests.test_sources import put

    options = {"paths": (f"{folder}/in",), "parser": "json", "schema": "id bigint", "manifest": f"{folder}/manifest"}

    def land():
        return lab.run(source="files", source_options=options)

    put(lab.spark, f"{folder}/in/a.json", '{"id": 1}\n')
    put(lab.spark, f"{folder}/in/bad.json", '{"id"\n')
    assert land().status == "partial_success"
    put(lab.spark, f"{folder}/in/b.json", '{"id": 2}\n')
    result = land()
    assert result.rows_read == 1 and len(result.failed_files) == 1 and rows(lab.landed) == [(2,)]


def test_processed_files_are_moved_after_the_run(lab, folder):
    from tests.test_sources import put

    put(lab.spark, f"{folder}/in/a.csv", "id\n1\n")
    put(lab.spark, f"{folder}/in/bad.csv", "id\nx\n")
    options = {"paths": (f"{folder}/in",), "parser": "csv", "schema": "id bigint", "processed_folder": f"{folder}/done"}
    assert lab.run(source="files", source_options=options, min_rows_expected=5).status == "failed"
    assert storage.exists(lab.spark, f"{folder}/in/a.csv")
    assert lab.run(source="files", source_options=options).status == "partial_success"
    assert storage.exists(lab.spark, f"{folder}/done/a.csv") and not storage.exists(lab.spark, f"{folder}/in/a.csv")
    assert storage.exists(lab.spark, f"{folder}/in/bad.csv")


def test_rest_source_in_a_pipeline(lab, folder):
    from siltbed.queries.fixtures import as_uri
    from siltbed.sources.rest import RestOptions, folder_get
    from tests.test_sources import put

    for page, ids in ((1, "[1, 2]"), (2, "[3]")):
        body = '{"d": [' + ", ".join(f'{{"id": {i}}}' for i in ids.strip("[]").split(", ")) + "]}"
        put(lab.spark, f"{folder}/api/page={page}/page_size=2/p.json", body)
    request = RestOptions(as_uri(storage.qualified(lab.spark, f"{folder}/api")), "d", "page", page_size=2)
    for schema in ("id bigint", None):
        options = {"options": request, "record_schema": schema, "transport": folder_get}
        assert lab.run(source="rest", source_options=options).rows_written == 3
        assert rows(lab.landed) == [(1,), (2,), (3,)]


def test_registered_sink(lab, folder):
    extensions.sink("json", lambda df, path: df.write.json(path))
    extensions.sink("lossy", lambda df, path: df.write.mode("overwrite").json(path) or 1)
    lab.set([(1,), (2,)])
    assert lab.run(sink="json", min_rows_expected=5).status == "failed"
    assert lab.run(sink="json").rows_written == 2
    assert lab.spark.read.json(f"{lab.root}bronze/p").count() == 2
    assert lab.run(sink="lossy").status == "failed"


class Killer:
    """Stops the process (as far as the library can tell) at the n-th file operation of a promotion."""

    OPERATIONS = ("write_text", "make_folder", "rename", "delete_trees")

    def __init__(self, monkeypatch, at):
        self.at, self.calls = at, []
        for name in self.OPERATIONS:
            real = getattr(storage, name)
            monkeypatch.setattr(storage, name, lambda *a, _real=real, _name=name: self.call(_real, _name, a))

    def call(self, real, name, args):
        self.calls.append(name)
        if len(self.calls) == self.at:
            raise KeyboardInterrupt
        return real(*args)


@pytest.mark.parametrize("mode", ["full_refresh", "incremental"])
@pytest.mark.parametrize("partition_by", ["none", "ingest_date"])
def test_a_kill_at_any_point_leaves_old_or_new_rows(lab, monkeypatch, mode, partition_by):
    changes = {"partition_by": partition_by, "extraction_mode": mode}
    if mode == "incremental":
        changes |= {"incremental_key": "id", "watermark_from": "run_start"}

    def run(ctx):
        spec = PipelineSpec("p", "bronze/p", source="lab", **changes)
        return run_pipeline(lab.spark, spec, ctx, lab.ledger_path, lab.root)

    def ids():
        return sorted(r.id for r in lab.landed.collect())

    old = [1, 2]
    lab.data = lab.spark.createDataFrame([(1,), (2,)], "id bigint")
    # The key only has to be there: the first run sees everything, later ones what the source gives.
    monkeypatch.setattr(runner, "after_watermark", lambda rows, key, mark: rows)
    assert run(RunContext(run_ts=T0)).status == "success"
    killed, at, outcomes = True, 0, set()
    while killed:
        at += 1
        value = 100 + at
        lab.data = lab.spark.createDataFrame([(value,)], "id bigint")
        new = [value] if mode == "full_refresh" else sorted([*old, value])
        ctx = RunContext(run_ts=T0 + timedelta(minutes=at))
        with monkeypatch.context() as patch:
            killer = Killer(patch, at)
            try:
                run(ctx)
                killed = False
            except KeyboardInterrupt:
                pass
        assert ids() in (old, new)  # before anything was recovered
        seen = ids()
        if killed:
            settled = runner.recover_unfinished(lab.spark, lab.ledger_path)
            assert settled == {ctx.run_id: "success" if seen == new else "failed"}
            last = ledger.run(lab.events, ctx.run_id).first()
            assert last["rows_written"] == (1 if seen == new else None)
            assert bool(last["watermark"]) == (seen == new)
            outcomes.add(settled[ctx.run_id])
        assert ids() == seen and runner.recover_unfinished(lab.spark, lab.ledger_path) == {}
        assert not list(storage.iter_files(lab.spark, f"{lab.root}bronze/p/_staging"))
        old = seen
    assert outcomes == {"failed", "success"} and len(killer.calls) == at - 1


def test_a_kill_before_the_outcome_is_recorded(lab, monkeypatch):
    lab.set([(1,), (2,)])
    lab.run()
    lab.set([(3,)])
    real, calls = ledger.append, []

    def append(*args):
        calls.append(args)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(*args)

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "append", append)
        with pytest.raises(KeyboardInterrupt):
            lab.run(min_rows_expected=1)
    assert rows(lab.landed) == [(3,)]
    (job_id, status), = runner.recover_unfinished(lab.spark, lab.ledger_path).items()
    last = ledger.run(lab.events, job_id).first()
    assert (status, last["rows_read"], last["rows_written"], len(last["last_schema"])) == ("success", 1, 1, 1)
    assert last["schema_hash"] and last["watermark"] == calls[1][2]["watermark"]
    assert rows(lab.landed) == [(3,)]


def landing_options(folder):
    return {"paths": (f"{folder}/in",), "parser": "json", "schema": "id bigint", "manifest": f"{folder}/manifest"}


def test_files_of_a_run_that_was_not_recorded_are_landed_once(lab, folder, monkeypatch):
    """Between promotion and the ledger, or with a source that cannot be tidied up: two rows, not four."""
    from tests.test_sources import put

    changes = {"source": "files", "source_options": landing_options(folder), "extraction_mode": "incremental", "incremental_key": "id"}
    monkeypatch.setattr(runner, "after_watermark", lambda rows, key, mark: rows)
    put(lab.spark, f"{folder}/in/a.json", '{"id": 1}\n{"id": 2}\n')
    real, calls = ledger.append, []

    def append(*args):
        calls.append(args)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(*args)

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "append", append)
        with pytest.raises(KeyboardInterrupt):
            lab.run(**changes)
    assert rows(lab.landed) == [(1,), (2,)]
    assert lab.run(**changes).rows_read == 0  # the open run holds its files
    assert list(runner.recover_unfinished(lab.spark, lab.ledger_path).values()) == ["success"]
    put(lab.spark, f"{folder}/in/b.json", '{"id": 3}\n')
    assert lab.run(**changes).rows_read == 1
    assert rows(lab.landed) == [(1,), (2,), (3,)]


@pytest.mark.parametrize("end", ["kill", "gate"])
def test_claims_of_a_run_that_failed_fall_back(lab, folder, monkeypatch, end):
    from tests.test_sources import put

    changes = {"source": "files", "source_options": landing_options(folder)}
    put(lab.spark, f"{folder}/in/a.json", '{"id": 1}\n{"id": 2}\n')
    if end == "gate":
        assert lab.run(**changes, min_rows_expected=5).status == "failed"
    else:
        with monkeypatch.context() as patch:
            patch.setattr(runner.parquet, "stage", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                lab.run(**changes)
        assert list(runner.recover_unfinished(lab.spark, lab.ledger_path).values()) == ["failed"]
    assert lab.run(**changes).rows_read == 2 and rows(lab.landed) == [(1,), (2,)]
    assert lab.run(**changes | {"extraction_mode": "full_refresh"}).rows_read == 0


def test_scratch_rows_are_deleted_with_the_run(lab, folder, monkeypatch):
    from siltbed.sources import files
    from tests.test_sources import put

    put(lab.spark, f"{folder}/in/a.json", '{"id": 1}\n')
    seen, real = [], files.scratch_path
    monkeypatch.setattr(files, "scratch_path", lambda *a: (seen.append(real(*a)), seen[-1])[1])
    assert lab.run(source="files", source_options=landing_options(folder)).status == "success"
    assert len(seen) == 1 and not storage.exists(lab.spark, seen[0])


def test_a_run_returns_its_alerts(lab):
    import json

    hook = {"webhook_url": "https://hooks.example.com/x", "alert_on": ("failed", "schema_changed")}

    def events(result):
        assert {a["webhook_url"] for a in result.alerts} <= {hook["webhook_url"]}
        bodies = [json.loads(a["payload"]) for a in result.alerts]
        assert all((b["job_id"], b["status"], b["rows_read"]) == (result.job_id, result.status, result.rows_read) for b in bodies)
        return [b["event"] for b in bodies]

    lab.set([(1,)])
    assert events(lab.run(**hook)) == []
    lab.set([(1, "a")], "id bigint, name string")
    assert events(lab.run(**hook, min_rows_expected=9)) == ["failed", "schema_changed"]
    assert events(lab.run(min_rows_expected=9)) == []
    assert events(lab.run(webhook_url=hook["webhook_url"], min_rows_expected=9)) == ["failed"]  # the default
    assert events(lab.run(**hook, webhook_hosts=("other.com",))) == []
    lab.set([(1,)])
    # The last accepted hash is the one with two columns; the failed runs did not move it.
    assert events(lab.run(**hook)) == ["schema_changed"]
    assert events(lab.run(**hook)) == []


def test_gated_sink_commits_or_aborts(lab, folder):
    out = folder.removeprefix("file://") if folder.startswith("file:") else folder

    def write(path, part, batches):
        import os

        os.makedirs(f"{out}/hidden", exist_ok=True)
        name = f"{out}/hidden/{part}"
        with open(name, "w") as file:
            for batch in batches:
                file.writelines(f"{v}\n" for v in batch.column("id").to_pylist())
        return name

    def commit(path, names):
        import os

        os.makedirs(f"{out}/shown", exist_ok=True)
        for name in names:
            os.rename(name, f"{out}/shown/{os.path.basename(name)}")

    def abort(path, names):
        import os

        for name in names:
            os.remove(name)

    import os

    extensions.gated_sink("table", write, commit, abort)
    lab.data = lab.spark.range(10).repartition(3)
    result = lab.run(sink="table", min_rows_expected=50)
    assert result.status == "failed" and "10 rows read, at least 50 expected" in result.error
    assert not os.path.exists(f"{out}/shown") and os.listdir(f"{out}/hidden") == []
    result = lab.run(sink="table", min_rows_expected=5)
    assert (result.status, result.rows_read, result.rows_written) == ("success", 10, 10)
    shown = [int(v) for name in os.listdir(f"{out}/shown") for v in open(f"{out}/shown/{name}")]
    assert sorted(shown) == list(range(10)) and os.listdir(f"{out}/hidden") == []
    lab.data = lab.spark.range(2)
    assert lab.run(sink="table", max_rows_drop_pct=20.0).status == "failed" and len(os.listdir(f"{out}/shown")) == 3


def test_the_next_run_settles_a_dead_one(lab, monkeypatch):
    lab.set([(1,)])
    lab.run()
    lab.set([(2,)])
    with monkeypatch.context() as patch:
        Killer(patch, 4)  # rows moved in, but not valid yet
        with pytest.raises(KeyboardInterrupt):
            lab.run()
    assert rows(lab.landed) == [(1,)] and ledger.latest(lab.events).filter("status = 'running'").count() == 1
    lab.run()
    assert ledger.latest(lab.events).filter("status = 'running'").count() == 1  # it may still be alive
    monkeypatch.setattr(runner, "RUN_TIMEOUT", -60)
    lab.set([(3,)])
    lab.run()
    states = sorted(r.status for r in ledger.latest(lab.events).collect())
    assert states == ["failed", "success", "success", "success"] and rows(lab.landed) == [(3,)]


@pytest.mark.parametrize("operation", ["rename", "delete_trees"])
def test_promotion_that_breaks_is_undone_or_counts(lab, monkeypatch, operation):
    """A store that fails before the rows are valid fails the run; one that fails while the old rows are deleted doesn't."""
    lab.set([(1,)])
    lab.run()
    lab.data = lab.spark.range(2, 10).repartition(4)
    real, calls = getattr(storage, operation), []

    def breaking(*args):
        calls.append(args)
        if len(calls) == 1:
            raise OSError("store is down")
        return real(*args)

    monkeypatch.setattr(storage, operation, breaking)
    result = lab.run()
    if operation == "rename":
        assert result.status == "failed" and result.watermark is None and rows(lab.landed) == [(1,)]
    else:
        assert result.status == "success" and any("store is down" in line for line in result.logs)
        assert rows(lab.landed) == [(i,) for i in range(2, 10)]
    assert len(list(storage.visible_entries(lab.spark, f"{lab.root}bronze/p"))) == 1


def test_one_rename_for_a_run_of_many_files(lab, monkeypatch):
    lab.data = lab.spark.range(100).repartition(20)
    lab.run()
    renamed, deleted = [], []
    real_rename, real_delete = storage.rename, storage.delete_trees
    monkeypatch.setattr(storage, "rename", lambda *a: (renamed.append(a[2]), real_rename(*a)))
    monkeypatch.setattr(storage, "delete_trees", lambda s, paths: (deleted.extend(paths), real_delete(s, paths))[1])
    lab.data = lab.spark.range(50).repartition(20)
    lab.run()
    assert len([r for r in renamed if "_staging" not in r]) == 1 and len(deleted) == 1
    assert lab.landed.count() == 50


def test_order_of_effects(lab, monkeypatch):
    seen = []
    for module, name in ((runner, "schema_hash"), (runner, "check_contract"), (runner, "mask_columns"), (runner.parquet, "stage"),
                         (runner, "check_gates"), (runner.parquet, "promote"), (runner.ledger, "append")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _real=real, _name=name, **k: (seen.append(_name), _real(*a, **k))[1])
    lab.set([(1,)])
    lab.run(expected_schema=[{"name": "id", "type": "int64"}])
    assert seen == ["append", "schema_hash", "check_contract", "mask_columns", "stage", "check_gates", "promote", "append"]


def test_ad_hoc_run_has_no_pipeline_history(spark, folder):
    result = run_extract(spark, spark.range(5), f"{folder}/x", RunContext(run_ts=T0), f"{folder}/ledger")
    events = ledger.read(spark, f"{folder}/ledger")
    assert (result.status, result.rows_written) == ("success", 5)
    assert ledger.watermarks(events).count() == 0 and ledger.schema_registry(events).count() == 0
    assert ledger.run(events, result.job_id).first()["rows_read"] == 5


def test_recover_removes_a_half_promoted_run(spark, folder, monkeypatch):
    parquet.promote(spark, parquet.stage(spark.range(3), folder, "r1"), replace=True)
    staged = parquet.stage(spark.range(3, 5), folder, "r2")
    with monkeypatch.context() as patch:
        Killer(patch, 4)
        with pytest.raises(KeyboardInterrupt):
            parquet.promote(spark, staged, replace=False)
    assert len(list(storage.visible_entries(spark, folder))) == 2
    assert rows(parquet.read_landed(spark, folder)) == [(0,), (1,), (2,)]
    assert parquet.recover(spark, folder, "r2") is None
    assert rows(spark.read.parquet(folder).select("id")) == [(0,), (1,), (2,)]


def test_several_partitions_become_valid_together(spark, folder, monkeypatch):
    def stage(first, run_id):
        data = spark.range(first, first + 6).selectExpr("id", "concat('d', id % 3) AS day")
        return parquet.stage(data, folder, run_id, "day")

    def ids():
        return sorted(r.id for r in parquet.read_landed(spark, folder).collect())

    parquet.promote(spark, stage(0, "r0"), replace=True)
    old, at, done = list(range(6)), 0, False
    while not done:
        at += 1
        staged, new = stage(at * 6, f"r{at}"), list(range(at * 6, at * 6 + 6))
        with monkeypatch.context() as patch:
            Killer(patch, at)
            try:
                parquet.promote(spark, staged, replace=True)
                done = True
            except KeyboardInterrupt:
                pass
        assert ids() in (old, new)
        old = ids()
        parquet.recover(spark, folder, f"r{at}")
        assert ids() == old
    assert at > 9 and old == new


def test_stale_staging_is_replaced(spark, folder):
    parquet.stage(spark.range(100), folder, "r1")
    staged = parquet.stage(spark.range(2), folder, "r1")
    assert (staged.rows_read, staged.rows_written) == (2, 2)


def test_ledger_compaction_keeps_every_event(lab):
    lab.set([(1,)])
    lab.run()
    lab.run()
    ledger.compact(lab.spark, lab.ledger_path, f"{lab.root}compacted")
    assert ledger.read(lab.spark, f"{lab.root}compacted").count() == 4  # a start and an end each
    assert len(list(storage.data_files(lab.spark, f"{lab.root}compacted"))) == 1


# ---- streaming


def test_stream_lands_each_file_once_and_masks(spark, folder):
    source = StreamOptions(f"{folder}/in", "json", "id bigint, email string", files_per_trigger=1)

    def land():
        land_stream(read_stream(spark, source), f"{folder}/out", f"{folder}/cp", pii_columns={"email": "sha256"}).awaitTermination()
        return spark.read.parquet(f"{folder}/out")

    spark.createDataFrame([(i, f"u{i}") for i in range(5)], "id bigint, email string").repartition(3).write.json(f"{folder}/in")
    assert land().count() == 5
    spark.createDataFrame([(i, None) for i in range(5, 12)], "id bigint, email string").write.mode("append").json(f"{folder}/in")
    landed = land()
    assert rows(landed.select("id")) == [(i,) for i in range(12)]
    assert landed.filter("email IS NOT NULL AND length(email) <> 64").count() == 0
    assert land().count() == 12


def test_repeated_batch_does_not_duplicate(spark, folder):
    source = StreamOptions(f"{folder}/in", "json", "id bigint")
    spark.range(4).write.json(f"{folder}/in")

    def land():
        land_stream(read_stream(spark, source), f"{folder}/out", f"{folder}/cp").awaitTermination()

    land()
    # The commit of batch 0 is lost, as after a crash behind promotion: the batch runs again.
    storage.delete_files(spark, [f"{folder}/cp/commits/0"])
    land()
    assert rows(parquet.read_landed(spark, f"{folder}/out")) == [(i,) for i in range(4)]


def test_stream_equals_batch(spark, folder):
    data = spark.range(50).select("id", F.concat(F.lit("n"), "id").alias("name"))
    data.repartition(4).write.json(f"{folder}/in")
    source = StreamOptions(f"{folder}/in", "json", "id bigint, name string", files_per_trigger=2)
    land_stream(read_stream(spark, source), f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert rows(parquet.read_landed(spark, f"{folder}/out")) == rows(spark.read.schema("id bigint, name string").json(f"{folder}/in"))


def test_archive_after_commit(spark, folder):
    source = StreamOptions(f"{folder}/in", "json", "id bigint", files_per_trigger=1, archive=f"{folder}/done")
    for i in range(3):
        spark.range(i, i + 1).coalesce(1).write.mode("append").json(f"{folder}/in")
    land_stream(read_stream(spark, source), f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 3
    assert any(storage.iter_files(spark, f"{folder}/done", ".json"))


def test_empty_partitioned_refresh_keeps_other_days(lab):
    for day, values in ((0, [(1,)]), (1, [(2,)]), (2, [])):
        lab.minutes = day * 24 * 60
        lab.set(values)
        assert lab.run(partition_by="ingest_date").status == "success"
    assert sorted(r.id for r in lab.landed.collect()) == [1, 2]


def test_same_run_id_replaces_its_own_rows(lab, folder):
    lab.set([(1,), (2,)])
    for run_id in ("job", "job", "job-1", "job"):
        staged = parquet.stage(lab.data, f"{folder}/t", run_id)
        parquet.promote(lab.spark, staged, replace=True)
        assert rows(parquet.read_landed(lab.spark, f"{folder}/t")) == [(1,), (2,)]
    parquet.recover(lab.spark, f"{folder}/t", "job")
    assert rows(parquet.read_landed(lab.spark, f"{folder}/t")) == [(1,), (2,)]
    with pytest.raises(ValueError):
        parquet.stage(lab.data, f"{folder}/t", "a~b")


def test_failing_archive_is_a_warning(lab, folder, monkeypatch):
    from tests.test_sources import put

    put(lab.spark, f"{folder}/in/a.json", '{"id": 1}\n')
    monkeypatch.setattr(runner, "finish_landing", lambda *a: (_ for _ in ()).throw(OSError("no such folder")))
    options = {"paths": (f"{folder}/in",), "parser": "json", "schema": "id bigint"}
    result = lab.run(source="files", source_options=options)
    assert result.status == "success" and any("not tidied up" in line for line in result.logs)
    assert rows(lab.landed) == [(1,)]


def test_a_limit_on_files_is_reported(lab, folder):
    from tests.test_sources import put

    for name, text in (("a", '{"id": 1}\n'), ("b", '{"id": 2}\n'), ("c", '{"id": 3, "x": "' + "y" * 200 + '"}\n')):
        put(lab.spark, f"{folder}/in/{name}.json", text)
    options = {"paths": (f"{folder}/in",), "parser": "json", "schema": "id bigint"}
    assert lab.run(source="files", source_options=options).rows_written == 3
    result = lab.run(source="files", source_options={**options, "max_files": 1})
    assert (result.status, result.rows_written, result.left_out) == ("partial_success", 1, 2)
    result = lab.run(source="files", source_options={**options, "max_file_bytes": 100})
    assert (result.status, result.rows_written, len(result.failed_files)) == ("partial_success", 2, 1)


def test_archive_keeps_files_of_the_same_name(lab, folder):
    from tests.test_sources import put

    for place, number in (("a", 1), ("b", 2)):
        put(lab.spark, f"{folder}/{place}/x.json", f'{{"id": {number}}}\n')
    options = {"paths": (f"{folder}/a", f"{folder}/b"), "parser": "json", "schema": "id bigint", "processed_folder": f"{folder}/done"}
    assert lab.run(source="files", source_options=options).rows_written == 2
    assert len(list(storage.iter_files(lab.spark, f"{folder}/done", ".json"))) == 2


def test_masks_find_columns_whatever_their_case(lab):
    lab.set([(1, "a@b")], "id bigint, userEmail string")
    result = lab.run(pii_columns={"useremail": "redact", "phone": "redact"})
    assert result.status == "success" and rows(lab.landed) == [(1, None)]
    assert any("phone" in line for line in result.logs)
    lab.set([(1, "a", "b")], "id bigint, Email string, EMAIL string")
    lab.spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert lab.run(pii_columns={"email": "redact"}).status == "failed"
    finally:
        lab.spark.conf.unset("spark.sql.caseSensitive")


def test_only_oracle_names_are_lower_cased(spark):
    from siltbed.sources.jdbc import as_named

    frame = spark.createDataFrame([(1,)], "userId bigint")
    assert as_named(frame, "jdbc:postgresql://h/d").columns == ["userId"]
    assert as_named(frame, "jdbc:oracle:thin:@h").columns == ["userid"]


def test_stream_keeps_files_with_broken_records_out(spark, folder):
    from tests.test_sources import put

    put(spark, f"{folder}/in/a.json", '{"id": 1}\n{"id": 2}\n')
    put(spark, f"{folder}/in/b.json", '{"id": 3}\n{"id"\n{"id": "x"}\n')
    source = StreamOptions(f"{folder}/in", "json", "id bigint")
    for checkpoint in ("cp1", "cp2"):  # two streams into one target leave each other's files alone
        land_stream(read_stream(spark, source), f"{folder}/out", f"{folder}/{checkpoint}").awaitTermination()
    assert rows(parquet.read_landed(spark, f"{folder}/out")) == [(1,), (1,), (2,), (2,)]
    noted = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/cp1/quarantine").collect()
    assert [(r["_source_file"].rsplit("/", 1)[-1], r["bad_records"]) for r in noted] == [("b.json", 2)]


def rules(folder, **changes):
    return BatchRules(f"{folder}/ledger", "stream", **changes)


def test_stream_batches_are_runs_with_one_event(spark, folder):
    from tests.test_sources import put

    source = StreamOptions(f"{folder}/in", "json", "id bigint")

    def land():
        land_stream(read_stream(spark, source), f"{folder}/out", f"{folder}/cp", rules=rules(folder)).awaitTermination()

    put(spark, f"{folder}/in/a.json", '{"id": 1}\n{"id": 2}\n')
    land()
    put(spark, f"{folder}/in/b.json", '{"id": 3}\n')
    put(spark, f"{folder}/in/c.json", '{"id"\n')
    land()
    # The commit of batch 1 is lost, as after a crash behind its event: the batch runs again and changes nothing.
    storage.delete_files(spark, [f"{folder}/cp/commits/1"])
    land()
    events = ledger.read(spark, f"{folder}/ledger").orderBy("seq").collect()
    assert [(e["status"], e["rows_read"], e["rows_written"], len(e["failed_files"])) for e in events] == [
        ("success", 2, 2, 0), ("partial_success", 1, 1, 1)]
    assert rows(parquet.read_landed(spark, f"{folder}/out")) == [(1,), (2,), (3,)]
    assert events[1]["failed_files"][0].endswith("c.json") and not events[1]["schema_changed"]


def test_a_batch_that_died_before_its_event_gets_one(spark, folder, monkeypatch):
    spark.range(4).coalesce(1).write.json(f"{folder}/in")
    source = StreamOptions(f"{folder}/in", "json", "id bigint")
    landing = sys.modules["siltbed.streaming.landing"]

    def land():
        land_stream(read_stream(spark, source), f"{folder}/out", f"{folder}/cp", rules=rules(folder)).awaitTermination()

    with monkeypatch.context() as patch:
        patch.setattr(landing, "record_run", lambda *a: (_ for _ in ()).throw(OSError("no ledger")))
        with pytest.raises(StreamingQueryException):
            land()
    assert rows(parquet.read_landed(spark, f"{folder}/out")) == [(i,) for i in range(4)]
    land()
    assert ledger.read(spark, f"{folder}/ledger").count() == 1
    assert rows(parquet.read_landed(spark, f"{folder}/out")) == [(i,) for i in range(4)]


@pytest.mark.parametrize("broken", [
    {"expected_schema": [{"name": "id", "type": "string"}]}, {"min_rows_expected": 5}, {"expected_schema": [{"name": "x", "type": "int64"}]},
])
def test_a_batch_that_breaks_a_rule_stops_the_stream_unseen(spark, folder, broken):
    spark.range(4).coalesce(1).write.json(f"{folder}/in")
    source = StreamOptions(f"{folder}/in", "json", "id bigint")

    def land(own):
        land_stream(read_stream(spark, source), f"{folder}/out", f"{folder}/cp", rules=own).awaitTermination()

    with pytest.raises(StreamingQueryException):
        land(rules(folder, **broken))
    assert not list(storage.data_files(spark, f"{folder}/out"))
    event = ledger.read(spark, f"{folder}/ledger").first()
    assert event["status"] == "failed" and ("contract" in event["error"] or "at least 5" in event["error"])
    land(rules(folder, min_rows_expected=4))
    assert parquet.read_landed(spark, f"{folder}/out").count() == 4


def test_stream_row_drop_is_measured_against_the_last_batch(spark, folder):
    source = StreamOptions(f"{folder}/in", "json", "id bigint")

    def land(limit):
        own = rules(folder, max_rows_drop_pct=limit)
        land_stream(read_stream(spark, source), f"{folder}/out", f"{folder}/cp", rules=own).awaitTermination()

    spark.range(10).coalesce(1).write.json(f"{folder}/in")
    land(20.0)
    spark.range(10, 15).coalesce(1).write.mode("append").json(f"{folder}/in")
    with pytest.raises(StreamingQueryException):
        land(20.0)
    assert parquet.read_landed(spark, f"{folder}/out").count() == 10
    land(60.0)
    assert parquet.read_landed(spark, f"{folder}/out").count() == 15


def test_text_keys_are_compared_as_times(spark):
    from siltbed.operators.incremental import after_watermark

    frame = spark.createDataFrame([("2024-06-01 10:00:00",), ("2024-05-31T23:00:00+00:00",), (None,)], "t string")
    assert rows(after_watermark(frame, "t", "2024-06-01T00:00:00+00:00")) == [("2024-06-01 10:00:00",)]
    with pytest.raises(Exception, match="holds no time"):
        after_watermark(spark.createDataFrame([("soon",)], "t string"), "t", "2024-06-01").collect()


def test_ad_hoc_runs_stay_in_their_folder(spark, folder):
    with pytest.raises(SpecError):
        run_extract(spark, spark.range(1), f"{folder}/../elsewhere", RunContext(run_ts=T0), f"{folder}/ledger")
