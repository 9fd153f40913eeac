from datetime import UTC, datetime

import pytest

from siltbed.plans.spec import (
    BackfillWindow,
    PipelineSpec,
    RunContext,
    SpecError,
    check_destination,
    check_host,
    check_key,
    resolve_path,
    resolve_variables,
    static_prefix,
)

MARCH = RunContext(run_ts=datetime(2026, 3, 25, 13, 0, tzinfo=UTC))


def at(*moment):
    return RunContext(run_ts=datetime(*moment, tzinfo=UTC))


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("d = @TODAY", "d = '2026-03-25'"),
        ("d > @MIN_DATE", "d > '1997-01-01'"),
        ("d >= @LAST_MONTH AND d < @NEXT_MONTH", "d >= '2026-02-01' AND d < '2026-04-01'"),
        ("@TODAY @TODAY", "'2026-03-25' '2026-03-25'"),
        ("SELECT 1", "SELECT 1"),
    ],
)
def test_variables(query, expected):
    assert resolve_variables(query, MARCH) == expected


def test_months_wrap_around_the_year():
    assert resolve_variables("@LAST_MONTH", at(2026, 1, 31, 12)) == "'2025-12-01'"
    assert resolve_variables("@NEXT_MONTH", at(2026, 12, 31, 12)) == "'2027-01-01'"


def test_clock_uses_the_configured_zone():
    assert resolve_variables("@TODAY", at(2026, 3, 25, 2)) == "'2026-03-24'"
    assert resolve_variables("@TODAY", RunContext(run_ts=datetime(2026, 3, 25, 2, tzinfo=UTC), tz="UTC")) == "'2026-03-25'"


def test_context_refuses_naive_time_and_odd_ids():
    with pytest.raises(SpecError):
        RunContext(run_ts=datetime(2026, 1, 1))
    with pytest.raises(SpecError):
        RunContext(run_id="a/b")
    with pytest.raises(SpecError):
        RunContext(triggered_by="cron")


def test_path_template():
    assert resolve_path("bronze/orders/{date}/", MARCH) == "bronze/orders/2026-03-25/"
    assert static_prefix("bronze/orders/{date}/x") == "bronze/orders/"
    assert static_prefix("bronze/orders/day-{date}") == "bronze/orders/"
    assert static_prefix("bronze/orders") == "bronze/orders"


@pytest.mark.parametrize("path", ["bronze/a", "s3://bronze/a", "s3a://bronze/a/b"])
def test_destination_accepted(path):
    assert check_destination(path) == path


@pytest.mark.parametrize("path", ["bronze/../gold", "bronze/%2e%2e/gold", "bronze/%2E%2E%2Fx", "silver/a", "s3://gold/x"])
def test_destination_refused(path):
    with pytest.raises(SpecError):
        check_destination(path)


def test_destination_prefix_can_be_changed():
    assert check_destination("raw/a", "raw/") == "raw/a"


@pytest.mark.parametrize("key", ["updated_at", "o.updated_at", "_x", "a1.b2"])
def test_key_accepted(key):
    assert check_key(key) == key


@pytest.mark.parametrize("key", ["", "1a", "a b", "a;drop", "a'", "a-b", "a\n"])
def test_key_refused(key):
    with pytest.raises(SpecError):
        check_key(key)


ALLOWED = ("db.internal", " example.com ", "10.0.0.0/8")


@pytest.mark.parametrize(
    "url",
    [
        "mysql://u:p@db.internal:3306/x",
        "postgresql://a.example.com/x",
        "jdbc:postgresql://10.1.2.3:5432/x",
        "https://example.com/hook",
        "jdbc:sqlserver://db.internal:1433;databaseName=x",
    ],
)
def test_host_allowed(url):
    assert check_host(url, ALLOWED) == url


@pytest.mark.parametrize("url", ["mysql://evil.com/x", "mysql://badexample.com/x", "mysql://11.0.0.1/x", "nonsense", "sqlite:x.db"])
def test_host_refused(url):
    with pytest.raises(SpecError):
        check_host(url, ALLOWED)


def test_no_host_list_allows_everything():
    assert check_host("anything") == "anything"


def test_backfill_needs_two_valid_bounds():
    BackfillWindow("2024-01-01", "2024-02-01T00:00:00+00:00")
    for bounds in (("2024-01-01", ""), ("", "2024-01-01"), ("yesterday", "2024-01-01")):
        with pytest.raises(SpecError):
            BackfillWindow(*bounds)


@pytest.mark.parametrize(
    "changes",
    [
        {"extraction_mode": "cdc"},
        {"extraction_mode": "incremental"},
        {"partition_by": "hour"},
        {"pii_columns": {"a": "rot13"}},
        {"destination": "gold/x"},
        {"incremental_key": "a b"},
        {"watermark_from": "max_key"},
        {"watermark_from": "guess"},
    ],
)
def test_spec_refused(changes):
    with pytest.raises(SpecError):
        PipelineSpec(**{"pipeline_id": "p", "destination": "bronze/p", **changes})
