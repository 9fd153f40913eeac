"""A bounded filter for semi-joins: which of many 64-bit values may belong to a set.

The set's members mark positions of a bit field whose size follows their number up to a fixed bound; Spark builds the
field in pieces, and the driver and each task hold one copy. A value that isn't marked isn't in the set; one that is
may be, so an exact join follows. Beyond the bound the filter lets more through and nothing else changes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 28  # 8 KB to 32 MB
PIECE_BITS = 15  # what bitmap_construct_agg puts into one value


def may_hold(field: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may belong to the set; bit i of the field is bit i % 8 of byte i // 8."""
    at = values.astype(np.int64) & (8 * len(field) - 1)
    return (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def marked(values: DataFrame, column: str, count: int) -> np.ndarray:
    """The field of a column of well-mixed 64-bit values, ``count`` of them; a plain array, fit for a broadcast."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * max(1, count)).bit_length()))
    at: Column = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    pieces = values.select(at.alias("at")).groupBy(F.shiftright("at", PIECE_BITS).alias("piece")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << PIECE_BITS) - 1))).alias("marks")
    )
    field = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (PIECE_BITS - 3)
    for row in pieces.toLocalIterator():  # at most 2^(28-15) pieces of 4 KB
        field[row.piece * width:(row.piece + 1) * width] = np.frombuffer(row.marks, np.uint8)
    return field
