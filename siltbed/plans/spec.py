"""What to land: pipeline definition, run clock, date variables, and the checks made before any data is read."""

from __future__ import annotations

import ipaddress
import re
import uuid
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from urllib.parse import unquote, urlsplit
from zoneinfo import ZoneInfo

# Defaults and limits that decide results.
DEFAULT_TIME_ZONE = "America/Sao_Paulo"
DEFAULT_MIN_DATE = "1997-01-01"
DEFAULT_PREFIX = "bronze/"
KEY_PATTERN = r"^[A-Za-z_][A-Za-z0-9_.]*$"
EXTRACTION_MODES = ("full_refresh", "incremental")
PARTITION_MODES = ("none", "ingest_date")
MASK_METHODS = ("sha256", "redact", "partial")
TRIGGERS = ("manual", "schedule", "backfill", "api")
DEFAULT_ALERTS = ("failed",)


class SpecError(ValueError):
    """A definition that must not run."""


@dataclass(frozen=True)
class RunContext:
    """One clock and one identity per run; every date in the run comes from here."""

    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    run_ts: datetime = field(default_factory=lambda: datetime.now(UTC))
    tz: str = DEFAULT_TIME_ZONE
    min_date: str = DEFAULT_MIN_DATE
    triggered_by: str = "manual"

    def __post_init__(self) -> None:
        if self.run_ts.tzinfo is None:
            raise SpecError("run_ts needs a time zone")
        if self.triggered_by not in TRIGGERS:
            raise SpecError(f"triggered_by must be one of {TRIGGERS}")
        if not re.fullmatch(r"[A-Za-z0-9-]+", self.run_id):
            raise SpecError("run_id may hold letters, digits and dashes only")

    @property
    def local_date(self) -> date:
        return self.run_ts.astimezone(ZoneInfo(self.tz)).date()


def _month_start(day: date, shift: int) -> date:
    months = day.year * 12 + day.month - 1 + shift
    return date(months // 12, months % 12 + 1, 1)


def date_variables(ctx: RunContext) -> dict[str, str]:
    today = ctx.local_date
    return {
        "TODAY": today.isoformat(),
        "MIN_DATE": ctx.min_date,
        "LAST_MONTH": _month_start(today, -1).isoformat(),
        "NEXT_MONTH": _month_start(today, 1).isoformat(),
    }


def resolve_variables(query: str, ctx: RunContext) -> str:
    """Replace ``@TODAY``, ``@MIN_DATE``, ``@LAST_MONTH`` and ``@NEXT_MONTH`` by quoted ISO dates."""
    values = date_variables(ctx)
    return re.sub(f"@({'|'.join(values)})", lambda m: f"'{values[m.group(1)]}'", query)


def resolve_path(template: str, ctx: RunContext) -> str:
    return template.replace("{date}", ctx.local_date.isoformat())


def static_prefix(template: str) -> str:
    """The part of a destination template that does not change from run to run (whole path segments)."""
    head, mark, _ = template.partition("{date}")
    return head if not mark else head[: head.rfind("/") + 1]


def check_key(key: str) -> str:
    if not re.match(KEY_PATTERN, key) or key.endswith("\n"):
        raise SpecError(f"incremental key {key!r} is not a plain column name")
    return key


def check_destination(path: str, allowed_prefix: str = DEFAULT_PREFIX) -> str:
    """Reject traversal (plain or percent-encoded) and anything outside the allowed prefix."""
    decoded = unquote(re.sub(r"s3a?://", "", path))
    if ".." in decoded:
        raise SpecError(f"destination {path!r} leaves its folder")
    if not decoded.startswith(allowed_prefix):
        raise SpecError(f"destination {path!r} is not below {allowed_prefix!r}")
    return path


def check_host(url: str, allowed: tuple[str, ...] = ()) -> str:
    """Allow exact hosts, their sub-domains, and addresses inside listed networks; no list allows everything."""
    if not allowed:
        return url
    authority = url.find("//")
    host = urlsplit(url[authority:]).hostname if authority >= 0 else None
    if host is None:
        raise SpecError("no host found in the connection address")
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        address = None
    for entry in (item.strip() for item in allowed):
        try:
            network = ipaddress.ip_network(entry, strict=False)
        except ValueError:
            network = None
        if network is not None and address is not None:
            if address in network:
                return url
        elif host == entry or host.endswith(f".{entry}"):
            return url
    raise SpecError(f"host {host!r} is not on the allow list")


@dataclass(frozen=True)
class BackfillWindow:
    """Half-open interval on the incremental key; both ends are required."""

    start: str
    end: str

    def __post_init__(self) -> None:
        for bound in (self.start, self.end):
            if not bound:
                raise SpecError("a backfill needs both bounds")
            try:
                datetime.fromisoformat(bound)
            except ValueError as error:
                raise SpecError(f"backfill bound {bound!r} is not ISO-8601") from error


@dataclass(frozen=True)
class PipelineSpec:
    """Definition of one landing pipeline.

    ``source`` is ``sql`` (``query`` is Spark SQL over registered tables), ``jdbc``, ``files``, ``rest`` or the name of
    a registered source; ``sink`` is ``parquet`` or the name of a registered sink (see ``siltbed.extensions``).
    ``write_tasks`` spreads rows over that many tasks and files; it is meant for sources that arrive in very few splits
    (one JDBC query, one REST endpoint, one row group) and costs a shuffle. ``webhook_url``, ``webhook_hosts`` (none: any)
    and ``alert_on`` decide which alerts a run returns; ``sla_minutes`` is for ``monitoring.sla_state``.
    """

    pipeline_id: str
    destination: str
    query: str = ""
    source: str = "sql"
    source_options: dict = field(default_factory=dict)
    sink: str = "parquet"
    connection_id: str | None = None
    extraction_mode: str = "full_refresh"
    incremental_key: str | None = None
    watermark_from: str = "run_start"
    partition_by: str = "none"
    compression: str = "snappy"
    write_tasks: int | None = None
    pii_columns: dict[str, str] = field(default_factory=dict)
    expected_schema: list[dict] | None = None
    min_rows_expected: int | None = None
    max_rows_drop_pct: float | None = None
    webhook_url: str | None = None
    webhook_hosts: tuple[str, ...] = ()
    alert_on: tuple[str, ...] = DEFAULT_ALERTS
    sla_minutes: int | None = None
    allowed_prefix: str = DEFAULT_PREFIX

    def __post_init__(self) -> None:
        if self.extraction_mode not in EXTRACTION_MODES:
            raise SpecError(f"extraction_mode must be one of {EXTRACTION_MODES}")
        if self.partition_by not in PARTITION_MODES:
            raise SpecError(f"partition_by must be one of {PARTITION_MODES}")
        if self.watermark_from not in ("run_start", "max_key"):
            raise SpecError("watermark_from must be run_start or max_key")
        if self.incremental_key is not None:
            check_key(self.incremental_key)
        elif self.extraction_mode == "incremental" or self.watermark_from == "max_key":
            raise SpecError("an incremental pipeline needs an incremental_key")
        unknown = sorted(set(self.pii_columns.values()) - set(MASK_METHODS))
        if unknown:
            raise SpecError(f"unknown mask methods {unknown}")
        check_destination(self.destination, self.allowed_prefix)
