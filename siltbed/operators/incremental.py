"""Incremental and backfill predicates as ordinary filters, so Catalyst pushes them into Parquet or JDBC scans."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.plans.spec import BackfillWindow, SpecError, check_key


def resolve_key(df: DataFrame, key: str) -> T.StructField:
    """Find the key among the columns; a qualified name may carry its table in front."""
    check_key(key)
    wanted = {key.lower(), key.rsplit(".", 1)[-1].lower()}
    for f in df.schema.fields:
        if f.name.lower() in wanted:
            return f
    raise SpecError(f"incremental key {key!r} is not a column of the result")


def key_literal(moment: str, data_type: T.DataType) -> Column:
    """ISO-8601 text as a literal of the key's type. Text without an offset is UTC.

    The offset is applied before the type is narrowed: casting offset text straight to ``timestamp_ntz`` would drop it.
    """
    try:
        parsed = datetime.fromisoformat(moment)
    except ValueError as error:
        raise SpecError(f"{moment!r} is not ISO-8601") from error
    utc = (parsed if parsed.tzinfo else parsed.replace(tzinfo=UTC)).astimezone(UTC)
    text = utc.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(data_type, T.TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    if isinstance(data_type, T.TimestampType):
        return F.lit(f"{text}+00:00").cast("timestamp")
    if isinstance(data_type, T.DateType):
        return F.lit(utc.date().isoformat()).cast("date")
    if isinstance(data_type, T.StringType):
        return F.lit(moment)
    raise SpecError(f"a key of type {data_type.simpleString()} cannot follow a time watermark")


def _comparable(df: DataFrame, f: T.StructField) -> tuple[Column, T.DataType]:
    """A date key is compared as its midnight, as the source databases do, so a later time that day excludes it.

    A text key is compared as the time it says, not letter by letter; text that says none stops the run.
    """
    column = df[f"`{f.name}`"]
    if isinstance(f.dataType, T.StringType):
        unread = F.raise_error(F.concat(F.lit(f"{f.name} holds no time: "), column)).cast("timestamp")
        return F.when(column.isNotNull(), F.coalesce(column.try_cast("timestamp"), unread)), T.TimestampType()
    if isinstance(f.dataType, T.DateType):
        return column.cast("timestamp_ntz"), T.TimestampNTZType()
    return column, f.dataType


def after_watermark(df: DataFrame, key: str, watermark: str | None) -> DataFrame:
    """Rows strictly newer than the watermark; the first run, which has none, reads everything."""
    field = resolve_key(df, key)
    if watermark is None:
        return df
    column, data_type = _comparable(df, field)
    return df.filter(column > key_literal(watermark, data_type))


def window_predicate(df: DataFrame, key: str, window: BackfillWindow) -> Column:
    """Membership in the half-open interval, so that neighbouring windows tile without overlap."""
    column, data_type = _comparable(df, resolve_key(df, key))
    return (column >= key_literal(window.start, data_type)) & (column < key_literal(window.end, data_type))


def in_window(df: DataFrame, key: str, window: BackfillWindow) -> DataFrame:
    return df.filter(window_predicate(df, key, window))
