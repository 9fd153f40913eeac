"""Variable-capacity best-fit packing of token sequences.

Lengths are small integers, so best-fit decreasing needs only how many pieces there are of each length: equal pieces
fill the tightest open bin until it is full, then the next, so whole classes of equal bins are filled at once. The
number of classes is bounded by the largest capacity, whatever the number of texts. When no open bin has room, the
permitted length that costs least for each token it will hold is opened; every choice of permitted lengths is packed,
each bin is cut down to the shortest permitted length that holds its contents, and the cheapest packing is taken.
Spark counts the lengths, ranks the pieces of each length and places each piece by its rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import scratch_path

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin: a fixed part, a part for each token, and attention's part for each pair of tokens.
BIN_COST, TOKEN_COST, PAIR_COST = 32.0, 1.0, 1.0 / 32768
RANK_BUCKETS = 256


def cost(capacity: int) -> float:
    return BIN_COST + TOKEN_COST * capacity + PAIR_COST * capacity * capacity


@dataclass
class Bins:
    """``count`` equal bins and what each holds: (length, how many) in the order they were put in."""

    capacity: int
    contents: tuple[tuple[int, int], ...]
    count: int

    @property
    def filled(self) -> int:
        return sum(length * many for length, many in self.contents)


def opened(length: int, many: int, smaller: int, capacities: tuple[int, ...]) -> int:
    """The permitted capacity that costs least for each token, counting on smaller pieces for the room left over."""

    def price(c: int) -> float:
        each = min(c // length, many)
        bins = -(-many // each)
        return cost(c) / (each * length + min(c - each * length, smaller / bins))

    return min((c for c in capacities if c >= length), key=lambda c: (price(c), c))


def best_fit(lengths: dict[int, int], capacities: tuple[int, ...]) -> list[Bins]:
    """Best-fit decreasing over (length: number of pieces); no length may exceed the largest capacity."""
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []
    done: list[Bins] = []

    def keep(bins: Bins, room: int) -> None:
        if room == 0:
            done.append(bins)
        elif room in by_room:
            by_room[room].append(bins)
        else:
            by_room[room] = [bins]
            insort(rooms, room)

    smaller = sum(length * n for length, n in lengths.items())
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        smaller -= length * left
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room = opened(length, left, smaller, capacities)
                bins = Bins(room, (), -(-left // (room // length)))
            each = room // length
            full, rest = min(bins.count, left // each), 0
            if full:
                keep(Bins(bins.capacity, (*bins.contents, (length, each)), full), room - each * length)
            if full < bins.count and (rest := left - full * each):
                keep(Bins(bins.capacity, (*bins.contents, (length, rest)), 1), room - rest * length)
            unused = bins.count - full - (rest > 0)
            if unused:
                keep(Bins(bins.capacity, bins.contents, unused), room)
            left -= full * each + rest
    return done + [b for room in rooms for b in by_room[room]]


def downsized(bins: list[Bins], capacities: tuple[int, ...]) -> list[Bins]:
    return [Bins(min(c for c in capacities if c >= b.filled), b.contents, b.count) for b in bins]


def best_packing(lengths: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> list[Bins]:
    """The cheapest packing over all choices of permitted lengths that include the largest needed."""
    capacities = tuple(sorted(capacities))
    if not lengths:
        return []
    needed = min(c for c in capacities if c >= max(lengths))
    least = None
    for many in range(len(capacities)):
        for others in combinations([c for c in capacities if c != needed], many):
            bins = downsized(best_fit(lengths, tuple(sorted((*others, needed)))), capacities)
            total = sum(b.count * cost(b.capacity) for b in bins)
            if least is None or total < least[0]:
                least = (total, bins)
    return least[1]


def runs_of(bins: list[Bins]) -> pd.DataFrame:
    """Where the pieces of each length go, by rank: (length, first rank, pieces per bin, first bin, offset, capacity)."""
    rows, first_bin, ranks = [], 0, {}
    for b in bins:
        offset = 0
        for length, many in b.contents:
            rank = ranks.get(length, 0)
            rows.append((length, rank, many, first_bin, offset, b.capacity))
            ranks[length] = rank + many * b.count
            offset += length * many
        first_bin += b.count
    frame = pd.DataFrame(rows, columns=["length", "rank", "each", "bin", "offset", "capacity"], dtype="int64")
    return frame.sort_values(["length", "rank"], ignore_index=True)


def token_estimate(text: Column) -> Column:
    """Words and single other signs of the whole text: a count that needs no vocabulary."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")), F.lit(0)).cast("long")


def packed(docs: DataFrame, length: Column, id_column: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id, piece, n_tokens, bin_id, capacity, offset.

    Texts longer than the largest capacity are cut into pieces of it and a rest; pieces of a text without tokens (also
    null) have no bin, capacity or offset. Repeated rows and null ids are packed each; an empty table gives no rows;
    other columns are not read. Ranks are counted in buckets by id, so a length that a third of all pieces share is
    ranked in many tasks. The driver sees one count for each length up to the largest capacity.
    """
    spark, most = docs.sparkSession, max(capacities)
    path = scratch_path(spark, "packing")
    sized = docs.select(F.col(id_column).alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("all"))
    pieces = sized.select("doc_id", "all", F.explode(
        F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("all") / most) - 1, F.lit(0).cast("long")))
    ).alias("piece"))
    pieces.select(
        "doc_id", "piece", F.least(F.lit(most).cast("long"), F.col("all") - F.col("piece") * most).alias("n_tokens")
    ).write.parquet(path)
    pieces = spark.read.parquet(path)
    counted = pieces.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r.n_tokens: r.n for r in counted.collect()}  # at most one row for each length up to the largest
    runs = runs_of(best_packing(lengths, tuple(capacities)))

    # The rank of a piece among those of its length: pieces in earlier buckets, then its place in its own.
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    own = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")
    ranked = bucketed.withColumn("place", F.row_number().over(own) - 1).join(offsets, ["n_tokens", "bucket"]).select(
        "doc_id", "piece", "n_tokens", (F.col("earlier") + F.col("place")).alias("rank")
    )
    firsts = np.cumsum([0] + [lengths[k] for k in sorted(lengths)])
    base = dict(zip(sorted(lengths), firsts.tolist()))
    starts = runs["length"].map(base).to_numpy(np.int64) + runs["rank"].to_numpy()
    table = {c: runs[c].to_numpy() for c in ("each", "bin", "offset", "capacity")}
    # Bounded by the largest capacity: some runs for each length.
    shared = spark.sparkContext.broadcast((base, starts, table))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, starts, table = shared.value
        for batch in batches:
            length = batch["n_tokens"].to_numpy()
            some = length > 0
            out = batch[["doc_id", "piece", "n_tokens"]].copy()
            columns = {c: pd.array([pd.NA] * len(batch), dtype="Int64") for c in ("bin_id", "capacity", "offset")}
            if some.any():
                at = batch["n_tokens"][some].map(base).to_numpy(np.int64) + batch["rank"].to_numpy()[some]
                run = np.searchsorted(starts, at, "right") - 1
                inside = at - starts[run]
                columns["bin_id"][some] = table["bin"][run] + inside // table["each"][run]
                columns["capacity"][some] = table["capacity"][run]
                columns["offset"][some] = table["offset"][run] + inside % table["each"][run] * length[some]
            yield out.assign(**columns)

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(
        placed, f"doc_id {kind}, piece long, n_tokens long, bin_id long, capacity long, offset long"
    )
