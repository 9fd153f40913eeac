"""Connected components of a distributed edge list by alternating large and small stars.

Every step joins each edge with the smallest neighbour of one end, an aggregate that is summed before the shuffle, and
writes its edges to the shared folder, so lineage stays short and a lost executor costs one step. Neither edges nor
components reach the driver; only a count and a checksum do, which tell when a round changed nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.session import scratch_path


def _checksum(edges: DataFrame):
    return edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges run from the larger end a to the smaller end b."""
    if large:
        ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = edges
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
    joined = ends.join(least, F.col("a") == F.col("u"))
    if large:
        moved = joined.filter(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: same type, not null); component is its smallest node."""
    spark = edges.sparkSession

    def written(frame: DataFrame) -> DataFrame:
        path = scratch_path(spark, "components")
        frame.write.parquet(path)
        return spark.read.parquet(path)

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _checksum(now)
    while before[0]:
        now = written(_stars(written(_stars(now, large=True)), large=False))
        after = _checksum(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
