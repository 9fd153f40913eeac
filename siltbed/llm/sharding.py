"""Minimax contiguous sharding with DataFrame functions only.

Groups of equal texts are atomic and ordered by a hash of the text. The smallest capacity with which a greedy walk over
the ordered groups needs no more than the given number of shards is found by binary search, and the walk at that
capacity gives the cuts. The walk doesn't need every group: a summary of hash ranges bounds the capacity from above
(ranges kept whole) and below (ranges divisible), and only ranges that a cut could fall into are split further, until
both bounds meet. The walk fills early shards to the brim, so the cuts are then moved as near to equal parts as that
capacity, and what must still fit behind them, allow. What reaches the driver is at most 4096 ranges and then 64 parts of each range near a cut.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import scratch_path

KEY_BITS = 63
FIRST_BITS = 12
MORE_BITS = 6
SLOT_BUCKETS = 1024
ROW_OVERHEAD = 8


@dataclass(frozen=True)
class Range:
    """Keys from ``first`` to ``first + 2**shift - 1``."""

    first: int
    shift: int
    weight: int
    groups: int


class Walk:
    """Greedy walks over ordered ranges; positions are prefix sums of weights."""

    def __init__(self, ranges: list[Range], shards: int):
        self.ranges, self.shards = ranges, shards
        self.ends = list(accumulate(r.weight for r in ranges))
        self.total = self.ends[-1]

    def reach(self, start: int, capacity: int, divisible: bool) -> int:
        want = start + capacity
        if want >= self.total:
            return self.total
        i = bisect_right(self.ends, want)
        if divisible and self.ranges[i].groups > 1:
            return want
        return self.ends[i - 1] if i else 0

    def cuts(self, capacity: int, divisible: bool) -> list[int]:
        at, out = 0, []
        for _ in range(self.shards):
            at = max(at, self.reach(at, capacity, divisible))
            out.append(at)
        return out

    def part(self, start: int, shards: int) -> float:
        """What the shard that begins at ``start`` should hold: an equal part of the rest, without ranges that are larger
        than that and need a shard each, fitted to a whole number of shards before the next of these."""
        weights = [r.weight for r in self.ranges[bisect_right(self.ends, start):]]
        total, least = sum(weights), 0
        for heavy in sorted((w for w in weights if w * shards > total), reverse=True):
            if shards == 1 or heavy * shards <= total:
                break
            total, shards, least = total - heavy, shards - 1, heavy
        level = total / shards
        before = 0
        for weight in weights if least else ():
            if weight >= least:
                return before / max(1, round(before / level)) if before else weight
            before += weight
        return level

    def balanced(self, capacity: int) -> list[int]:
        """Ends of at most ``shards`` shards within the capacity, each as near as whole ranges allow to an equal part of
        what is left.

        A cut may lie no further left than the point from which a walk from the right end still gets by with the shards
        that follow; no further right than the capacity reaches.
        """
        starts = [0, *self.ends]
        earliest = [self.total]  # of the last shard's end, then of the one before, ...
        for _ in range(self.shards - 1):
            earliest.append(starts[bisect_left(starts, earliest[-1] - capacity)] if earliest[-1] > capacity else 0)
        at, out = 0, []
        for i in range(self.shards):
            left = self.shards - i
            latest = starts[bisect_right(starts, at + capacity) - 1]
            wanted = at + self.part(at, left)
            after = min(bisect_left(starts, wanted), len(starts) - 1)
            nearest = min((starts[max(0, after - 1)], starts[after]), key=lambda end: abs(end - wanted))
            following = starts[min(bisect_right(starts, at), len(starts) - 1)]
            at = min(max(nearest, following, earliest[left - 1]), latest)
            out.append(at)
        return out

    def least(self, low: int, high: int, divisible: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, divisible)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low


def _summary(groups: DataFrame, shift: int, within: list[int] | None, parent_shift: int) -> list[Range]:
    if within is not None:
        groups = groups.filter(F.shiftright("key", parent_shift).isin(within))
    rows = (
        groups.groupBy(F.shiftright("key", shift).alias("prefix"))
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return [Range(r.prefix << shift, shift, r.weight, r.n) for r in sorted(rows, key=lambda r: r.prefix)]


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity and the first key of every shard but the first, for ``groups`` of (key, weight)."""
    largest = groups.agg(F.max("weight")).first()[0]
    if largest is None:
        return 0, []
    shift = KEY_BITS - FIRST_BITS
    ranges = _summary(groups, shift, None, KEY_BITS)
    while True:
        walk = Walk(ranges, shards)
        least = max(largest, -(-walk.total // shards))
        low = walk.least(least, walk.total, divisible=True)
        high = walk.least(max(low, max(r.weight for r in ranges)), walk.total, divisible=False)
        if low == high:
            break
        windows = list(zip(walk.cuts(low, False), walk.cuts(high, True)))
        open_ = [
            r for r, end in zip(ranges, walk.ends)
            if r.groups > 1 and any(a < end and end - r.weight <= b for a, b in windows)
        ]
        if not open_:
            break
        parent, shift = open_[0].shift, max(0, open_[0].shift - MORE_BITS)
        finer = _summary(groups, shift, [r.first >> parent for r in open_], parent)
        gone = set(open_)
        ranges = sorted([r for r in ranges if r not in gone] + finer, key=lambda r: r.first)
    starts = []
    for end in walk.balanced(high)[:-1]:
        used = bisect_right(walk.ends, end)
        if used < len(ranges):
            starts.append(ranges[used].first)
    return high, starts


def sharded(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes (null: none) plus 8. Equal texts, null among them, are one group and share a shard,
    whatever their number; the largest shard is as small as contiguous groups allow. Slots are gapless from 0 in each
    shard, also for repeated rows and null ids. An empty table gives no rows; other columns are not read. A group of
    copies is summed before the shuffle, and slots are counted in buckets by id, so neither a hot text nor a hot source
    meets in one task.
    """
    spark = docs.sparkSession
    base_path = scratch_path(spark, "sharding")
    text_ = F.col(text)
    docs.select(
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length(text_), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text_, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text_).bitwiseAND(F.lit((1 << KEY_BITS) - 1)).alias("key"),
    ).write.parquet(f"{base_path}/rows")
    base = spark.read.parquet(f"{base_path}/rows")
    base.groupBy("key").agg(F.sum("size").alias("weight")).write.parquet(f"{base_path}/groups")
    _, starts = smallest_capacity(spark.read.parquet(f"{base_path}/groups"), shards)

    shard = F.lit(0)
    for start in starts:  # at most one comparison for each shard
        shard = shard + (F.col("key") >= F.lit(start)).cast("int")
    bucket = F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_BUCKETS)).cast("int")
    placed = base.select("*", shard.alias("shard"), bucket.alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "key")
    return (
        placed.withColumn("place", F.row_number().over(own) - 1)
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
