"""Pipeline registry as a table: live rows, tombstones with cascade, partial updates, unique names."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("deleted_at").isNull())


def listing(registry: DataFrame, tie_break: str = "id") -> DataFrame:
    """Live entries in order of creation."""
    return live(registry).orderBy("created_at", tie_break)


def tombstone(registry: DataFrame, doomed: DataFrame, moment: datetime | Column, key: str = "id") -> DataFrame:
    """Mark the entries named by ``doomed`` as deleted; entries already deleted keep their time."""
    when = moment if isinstance(moment, Column) else F.lit(moment)
    marks = doomed.select(key).distinct().withColumn("__doomed", F.lit(True))
    kind = registry.schema["deleted_at"].dataType
    return (
        registry.join(marks, key, "left")
        .withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("__doomed"), when.cast(kind))))
        .drop("__doomed")
    )


def cascade(children: DataFrame, parents: DataFrame, reference: str, parent_key: str = "id") -> DataFrame:
    """Children of a deleted parent are deleted with it, at the parent's time."""
    gone = parents.filter(F.col("deleted_at").isNotNull()).select(
        F.col(parent_key).alias(reference), F.col("deleted_at").alias("__parent_gone")
    )
    return (
        children.join(gone, reference, "left")
        .withColumn("deleted_at", F.coalesce("deleted_at", "__parent_gone"))
        .drop("__parent_gone")
    )


def duplicate_names(registry: DataFrame, name: str = "name") -> DataFrame:
    """Names used by more than one live entry."""
    return live(registry).groupBy(name).agg(F.count(F.lit(1)).alias("entries")).filter(F.col("entries") > 1)


def patch(registry: DataFrame, changes: DataFrame, fields: list[str], clearable: list[str], key: str = "id") -> DataFrame:
    """Apply partial updates: NULL keeps the old value, except that a clearable field named in ``supplied`` is cleared."""
    renamed = changes.select(
        key, "supplied", F.lit(True).alias("__patched"), *[F.col(f).alias(f"__{f}") for f in fields]
    )
    merged = registry.join(renamed, key, "left")
    updated = {
        f: F.when(F.col("__patched") & F.array_contains("supplied", f), F.col(f"__{f}")).otherwise(
            F.coalesce(f"__{f}", f)
        )
        if f in clearable
        else F.coalesce(f"__{f}", f)
        for f in fields
    }
    return merged.withColumns(updated).select(*registry.columns)
