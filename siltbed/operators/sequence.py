"""Lookups of an earlier row that hold up when one key owns a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import scratch_path


def with_previous(
    df: DataFrame, key: str, seq: str, values: dict[str, str], when: Column | None = None
) -> DataFrame:
    """Add the values of the nearest preceding row (by ``seq``, a unique number) of the same key.

    With ``when``, rows for which it doesn't hold are passed over, so the lookup is of the last row that counted.
    ``values`` maps new names to existing columns; without such a row they are NULL. Rows without a key share one.

    Rows are dealt to partitions by ranges of (key, seq), so a key of any size is spread over as many as it needs, and
    written once. A window then works inside each partition; what it cannot see, the last counting row of earlier
    partitions, is at most one row for each partition, because only one key can continue from the partition before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sequence")
    df.repartitionByRange(key, seq).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    counts = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    found = F.struct(*[F.col(source).alias(name) for name, source in values.items()])

    in_part = Window.partitionBy(key, "__part").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__near", F.last(F.when(counts, found), ignorenulls=True).over(in_part))

    ends = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__at")).agg(
        F.max_by(found, F.when(counts, F.col(seq))).alias("__end")
    )
    earlier = Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__key", "__at", F.last("__end", ignorenulls=True).over(earlier).alias("__far")).filter(
        F.col("__far").isNotNull()
    )
    joined = local.join(
        F.broadcast(carried),  # fewer rows than partitions
        F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at")), "left",
    )
    nearest = F.coalesce("__near", "__far")
    return joined.select(*df.columns, *[nearest[name].alias(name) for name in values])
