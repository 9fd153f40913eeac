"""How much Spark hands to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, whatever the length of the texts: the default bounds only their number."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
