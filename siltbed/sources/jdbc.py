"""JDBC source: a query pushed to the database, optionally read in parallel ranges of a numeric column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.plans.spec import RunContext, check_host, resolve_variables
from siltbed.sources.sql import lower_case_columns

# Fixed values.
CONNECT_TIMEOUT_SECONDS = 30
FETCH_ROWS = 50_000


@dataclass(frozen=True)
class JdbcSource:
    url: str
    query: str
    properties: dict[str, str] = field(default_factory=dict)
    partition_on: str | None = None
    partition_num: int | None = None
    partition_range: tuple[int, int] | None = None
    fetch_rows: int = FETCH_ROWS
    connect_timeout: int = CONNECT_TIMEOUT_SECONDS
    custom_schema: str | None = None
    allowed_hosts: tuple[str, ...] = ()


def with_connect_timeout(url: str, seconds: int = CONNECT_TIMEOUT_SECONDS) -> str:
    """PostgreSQL addresses get a connect timeout unless they carry one; others are left alone."""
    if not re.match(r"(jdbc:)?postgres", url):
        return url
    base, _, query = url.partition("?")
    present = {name.lower() for name, _ in parse_qsl(query)}
    if present & {"connecttimeout", "connect_timeout"}:
        return url
    name = "connectTimeout" if url.startswith("jdbc:") else "connect_timeout"
    return f"{base}?{query + '&' if query else ''}{urlencode({name: seconds})}"


def reader_options(source: JdbcSource, query: str) -> dict[str, str]:
    """Options of Spark's JDBC reader. The query is a derived table because ranges cannot split the ``query`` option."""
    options = {
        **source.properties,
        "url": with_connect_timeout(source.url, source.connect_timeout),
        "dbtable": f"({query.rstrip().rstrip(';')}) q",
        "fetchsize": str(source.fetch_rows),
    }
    if source.custom_schema:
        options["customSchema"] = source.custom_schema
    return options


def range_options(source: JdbcSource, bounds: tuple[int, int]) -> dict[str, str]:
    """Bounds only set the stride of the ranges: rows outside them, and NULL keys, are still read."""
    return {
        "partitionColumn": source.partition_on,
        "lowerBound": str(bounds[0]),
        "upperBound": str(max(bounds[1], bounds[0] + 1)),
        "numPartitions": str(source.partition_num),
    }


def plain_numbers(df: DataFrame) -> DataFrame:
    """Oracle numbers as plain ones: no decimals means 64-bit integer, otherwise double."""
    decimals = {f.name: f.dataType.scale for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    casts = {n: F.col(f"`{n}`").cast("bigint" if scale == 0 else "double") for n, scale in decimals.items()}
    return df.withColumns(casts) if casts else df


def as_named(rows: DataFrame, url: str) -> DataFrame:
    """Oracle answers in upper case and with decimals for all numbers; other databases keep names and types."""
    return plain_numbers(lower_case_columns(rows)) if url.startswith("jdbc:oracle:") else rows


def read_jdbc(spark: SparkSession, source: JdbcSource, ctx: RunContext) -> DataFrame:
    check_host(source.url, source.allowed_hosts)
    query = resolve_variables(source.query, ctx)
    options = reader_options(source, query)
    if source.partition_on and source.partition_num and source.partition_num > 1:
        bounds = source.partition_range
        if bounds is None:
            edge = dict(options)
            edge["dbtable"] = (
                f"(SELECT min({source.partition_on}) AS lo, max({source.partition_on}) AS hi "
                f"FROM {options['dbtable']}) b"
            )
            row = spark.read.format("jdbc").options(**edge).load().first()
            bounds = None if row[0] is None else (int(row[0]), int(row[1]))
        if bounds is not None:
            options |= range_options(source, bounds)
    return as_named(spark.read.format("jdbc").options(**options).load(), source.url)
