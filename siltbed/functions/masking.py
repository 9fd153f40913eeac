"""Masking and redaction as column expressions: everything stays in generated JVM code, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and names that decide results.
URI_CREDENTIALS = r"(://)[^:]+:[^@]+(@)"
URI_REPLACEMENT = "$1***:***$2"
SECRET_FIELDS = ("password", "secret", "secret_key", "access_key", "connection", "token", "credentials_json")
SECRET_REPLACEMENT = '$1"***"'


def _trimmed(number: Column) -> Column:
    """Positional digits without trailing zeros, one kept after the point."""
    return F.regexp_replace(F.regexp_replace(number.cast("string"), "0+$", ""), r"\.$", ".0")


def _float_text(value: Column) -> Column:
    """Shortest decimal text: positional from 1e-4 up to 1e16, otherwise exponent form with two exponent digits."""
    d = value.cast("double")
    text = d.cast("string")
    size = F.abs(d)
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.abs(exponent).cast("string")
    scientific = F.concat(
        F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits),
    )
    return (
        F.when(F.isnan(d), F.lit("nan"))
        .when(d == F.lit(float("inf")), F.lit("inf"))
        .when(d == F.lit(float("-inf")), F.lit("-inf"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e7) & (size < 1e16), _trimmed(text.try_cast("decimal(38,18)")))
        .when((size >= 1e-4) & (size < 1e-3), _trimmed(text.try_cast("decimal(38,30)")))
        .otherwise(scientific)
    )


def utc_wall_time(value: Column) -> Column:
    """A ``timestamp`` as ``timestamp_ntz`` in UTC, whatever the session zone."""
    seconds = (F.unix_micros(value).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def _wall_time_text(value: Column) -> Column:
    """Seconds, then either no fraction or all six digits of it."""
    text = value.cast("string")
    return F.when(F.length(text) == 19, text).otherwise(F.rpad(text, 26, "0"))


def canonical_text(value: Column, data_type: T.DataType) -> Column:
    """The text that is hashed, equal to Python's ``str`` of the same value for every scalar type but binary."""
    if isinstance(data_type, T.BooleanType):
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(value.isNotNull(), _float_text(value))
    if isinstance(data_type, T.TimestampNTZType):
        return _wall_time_text(value)
    if isinstance(data_type, T.TimestampType):
        return F.concat(_wall_time_text(utc_wall_time(value)), F.lit("+00:00"))
    return value.cast("string")


def sha256_mask(value: Column, data_type: T.DataType) -> Column:
    """Lower-case hex digest; NULL stays NULL."""
    return F.sha2(canonical_text(value, data_type), 256)


def redact_mask(data_type: T.DataType) -> Column:
    """NULL of the column's own type, so the dataset's schema does not change."""
    return F.lit(None).cast(data_type)


def partial_mask(value: Column) -> Column:
    """First and last character kept, the middle starred; fewer than three characters are starred entirely."""
    text = value.cast("string")
    n = F.length(text)
    star = F.lit("*")
    return F.when(n < 3, F.repeat(star, n)).otherwise(
        F.concat(F.left(text, F.lit(1)), F.repeat(star, n - 2), F.right(text, F.lit(1)))
    )


def mask_names(df: DataFrame, methods: dict[str, str]) -> dict[str, str]:
    """The column each listed name stands for: the same name, else the only one that differs in case.

    Names that stand for no column are left out. Two columns that differ from a name only in case are refused, as one
    of them would stay unmasked.
    """
    found = {}
    for name in methods:
        same = [c for c in df.columns if c == name] or [c for c in df.columns if c.lower() == name.lower()]
        if len(same) > 1:
            raise ValueError(f"{name!r} could be any of the columns {same}")
        if same:
            found[name] = same[0]
    return found


def mask_columns(df: DataFrame, methods: dict[str, str]) -> DataFrame:
    """Mask the listed columns that exist, whatever the case of their names; names that are absent are ignored."""
    types = {f.name: f.dataType for f in df.schema.fields}
    masked: dict[str, Column] = {}
    for listed, name in mask_names(df, methods).items():
        method = methods[listed]
        value = df[f"`{name}`"]
        if method == "sha256":
            masked[name] = sha256_mask(value, types[name])
        elif method == "redact":
            masked[name] = redact_mask(types[name])
        elif method == "partial":
            masked[name] = partial_mask(value)
        else:
            raise ValueError(f"unknown mask method {method!r}")
    return df.withColumns(masked) if masked else df


def mask_uri(value: Column) -> Column:
    """Hide user and password inside connection addresses."""
    return F.regexp_replace(value, URI_CREDENTIALS, URI_REPLACEMENT)


def redact_json_secrets(value: Column) -> Column:
    """Replace the string values of secret-bearing JSON fields, whatever the case of the field name."""
    pattern = f'(?i)("(?:{"|".join(SECRET_FIELDS)})"\\s*:\\s*)"[^"]*"'
    return F.regexp_replace(value, pattern, SECRET_REPLACEMENT)
