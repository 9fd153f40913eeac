"""Gates evaluated between staging and promotion, and the status a run ends with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class GateError(ValueError):
    """A run whose data must not become visible."""


def min_rows_violated(rows: Column, minimum: Column | int) -> Column:
    return F.coalesce(rows < minimum, F.lit(False))


def drop_percent(rows: Column, previous: Column) -> Column:
    """Loss against the previous run in per cent; NULL when there is nothing to compare with."""
    return (F.lit(1.0) - rows / F.nullif(previous, F.lit(0))) * 100


def row_drop_violated(rows: Column, previous: Column, max_drop: Column | float) -> Column:
    return F.coalesce(drop_percent(rows, previous) > max_drop, F.lit(False))


def check_gates(rows: int, minimum: int | None, max_drop: float | None, previous: int | None) -> None:
    """The same two gates on the numbers of one run."""
    if minimum is not None and rows < minimum:
        raise GateError(f"{rows} rows read, at least {minimum} expected")
    if max_drop is not None and previous:
        drop = (1 - rows / previous) * 100
        if drop > max_drop:
            raise GateError(f"{rows} rows read, {drop:.1f}% fewer than the previous {previous}; limit {max_drop}%")


def resolved_status(rows_read: Column, rows_written: Column, failed_files: Column, error: Column) -> Column:
    """failed on an error or a count mismatch, partial_success when files were left out, else success."""
    return (
        F.when(error.isNotNull(), "failed")
        .when(~rows_read.eqNullSafe(rows_written), "failed")
        .when(failed_files > 0, "partial_success")
        .otherwise("success")
    )
