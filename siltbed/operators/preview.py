"""Bounded look at a query's result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from siltbed.plans.spec import RunContext
from siltbed.sources.sql import query_source

PREVIEW_ROWS = 100


@dataclass(frozen=True)
class PreviewResult:
    columns: list[str]
    rows: list[Row]
    row_count: int


def preview_frame(spark: SparkSession, query: str, ctx: RunContext, rows: int = PREVIEW_ROWS) -> DataFrame:
    """At most ``rows`` rows of the query, whether or not it has its own limit."""
    return query_source(spark, query, ctx).limit(rows)


def preview(spark: SparkSession, query: str, ctx: RunContext, rows: int = PREVIEW_ROWS) -> PreviewResult:
    found = preview_frame(spark, query, ctx, rows)
    collected = found.collect()
    return PreviewResult(found.columns, collected, len(collected))
