"""Whitening of embeddings by their leading principal components.

Entries become whole numbers first, so sums and deviations are exact whatever the order in which tasks add them. Spark
sums the vectors, then the products of centred vectors; what reaches the driver is one covariance matrix, as wide as a
vector. Its eigenpairs come from Householder tridiagonalisation, bisection by Sturm counts and inverse iteration with
reorthogonalised clusters (``symmetric_eigen``); the projection is broadcast, one column for each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.symmetric_eigen import leading_eigenpairs
from siltbed.session import scratch_path

STEPS, OFFSET = 1024, 100_000
COMPONENTS = 8
LARGEST_ENTRY = 2.0**61  # of a scaled entry, so that it is a long
LIMB_BITS = 30
#: An eigenvalue below this part of the trace is rounding, and its component has no scale.
LEAST_PART = 1e-13


def whole_vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(length of each usable vector or -1, all entries as longs) of a batch's column ``vector`` of doubles."""
    column = batch.column("vector")
    ends = np.asarray(column.offsets, np.int64)
    entries = column.values.to_numpy(zero_copy_only=False)  # null entries become nan
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(STEPS * entries)
        good = np.abs(scaled) < LARGEST_ENTRY
    bad_before = np.concatenate([[0], np.cumsum(~good)])
    lengths = np.diff(ends)
    usable = (bad_before[ends[1:]] == bad_before[ends[:-1]]) & (lengths > 0)
    usable &= ~np.asarray(column.is_null())
    return np.where(usable, lengths, -1), np.where(good, scaled, 0).astype(np.int64) + OFFSET


def matrix_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable vectors of ``width`` entries, and these vectors."""
    lengths, entries = whole_vectors(batch)
    rows = np.flatnonzero(lengths == width)
    starts = np.asarray(batch.column("vector").offsets, np.int64)[:-1][rows]
    return rows, entries[starts[:, None] + np.arange(width)]


def vectors_of(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return rows.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))


def sums_by_length(vectors: DataFrame) -> DataFrame:
    """(width, at, n, total) for each length of usable vectors and each position; totals are exact."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            lengths, _ = whole_vectors(batch)
            for width in np.unique(lengths[lengths > 0]).tolist():
                _, x = matrix_of(batch, width)
                high, low = x >> LIMB_BITS, x & ((1 << LIMB_BITS) - 1)
                total = high.sum(0).astype(object) * (1 << LIMB_BITS) + low.sum(0).astype(object)
                n, before = held.get(width, (0, 0))
                held[width] = (n + len(x), before + total)
        for width, (n, total) in held.items():
            yield pa.RecordBatch.from_pydict({
                "width": pa.array([width] * width, pa.int32()), "at": pa.array(range(width), pa.int32()),
                "n": pa.array([n] * width, pa.int64()), "total": pa.array([str(t) for t in total], pa.string()),
            })

    parts = vectors.select("vector").mapInArrow(summed, "width int, at int, n long, total string")
    return parts.groupBy("width", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )


@dataclass(frozen=True)
class Centre:
    """Exact sums of n vectors; a mean is a whole part and a rest of at most a half, so differences lose no digits."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.whole)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2, exact; null where it is no long."""
        apart = x - self.whole
        left = [s - self.n * int(m) for s, m in zip(self.sums, self.whole)]  # below n
        most = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if most * most * len(left) < 2**63:
            return ((apart * self.n - np.array(left, np.int64)) ** 2).sum(1).tolist()
        exact = ((apart.astype(object) * self.n - np.array(left, object)) ** 2).sum(1)
        return [v if v < 2**63 else None for v in exact.tolist()]


def most_common_length(sums: DataFrame) -> Centre | None:
    """Sums of the vectors of the most frequent length (of equally frequent ones the largest)."""
    chosen = sums.groupBy("width").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if chosen is None:
        return None
    rows = sums.filter(F.col("width") == chosen.width).orderBy("at").collect()  # one row for each entry of a vector
    return Centre(chosen.n, tuple(int(r.total) for r in rows))


def covariance(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """Covariance of all usable vectors, centred before multiplying, divisor n."""
    width = len(centre.sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((width, width))
        for batch in batches:
            y = centre.centred(matrix_of(batch, width)[1])
            held += y.T @ y
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(held[i, j])], ["i", "j", "product"]
        )

    parts = vectors.select("vector").mapInArrow(products, "i int, j int, product double")
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("product").alias("product")).collect():  # one entry of the matrix each
        out[r.i, r.j] = out[r.j, r.i] = r.product / centre.n
    return out


def identity_error(projected: DataFrame, many: int, n: int) -> float:
    """Largest absolute entry of the covariance of column ``w``, centred before multiplying, minus the identity."""
    means = projected.agg(*[(F.sum(F.col("w")[i]) / n).alias(f"m{i}") for i in range(many)]).first()
    y = [F.col("w")[i] - F.lit(means[i]) for i in range(many)]
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    row = projected.agg(*[(F.sum(y[i] * y[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(row, pairs))


def whitened(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per usable vector and leading component: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    An entry c counts as floor(1024 * c) + 100000. Usable are vectors without null, non-finite or, scaled, too large
    entries that have the table's most frequent length (of equally frequent ones the largest); null, empty and other
    vectors have no rows. Components are numbered from 1 by falling eigenvalue; there are as many as asked for, less where the
    covariance has a lower rank (one vector, or equal ones: none, so no rows). ``deviation`` is exact, null where it exceeds a
    long. Repeated rows and null ids count each; an empty table gives no rows; other columns are not read.

    Two passes over the table and two over the projections, none of which moves a vector: tasks send sums only.
    """
    spark = rows.sparkSession
    vectors = vectors_of(rows, id_column, vector_column)
    id_type = vectors.schema["vec_id"].dataType
    centre = most_common_length(sums_by_length(vectors))
    values, directions, trace = np.zeros(0), np.zeros((0, 0)), 1.0
    if centre is not None:
        matrix = covariance(vectors, centre)
        values, directions = leading_eigenpairs(matrix, components)
        trace = float(np.trace(matrix))
        kept = values > LEAST_PART * trace
        values, directions = values[kept], directions[:, kept]
    if not len(values):
        none = T.StructType().add("vec_id", id_type)
        for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"),
                           ("explained", "double"), ("identity_error", "double")):
            none = none.add(name, kind)
        return spark.createDataFrame([], none)

    # Bounded: a vector's width times the number of components.
    shared = spark.sparkContext.broadcast(directions / np.sqrt(values))
    width, many = len(centre.sums), len(values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = shared.value
        for batch in batches:
            found, x = matrix_of(batch, width)
            w = centre.centred(x) @ projection
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(found)),
                pa.array(centre.deviations(x), pa.int64()),
                pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * many, many, dtype=np.int32), w.ravel()),
            ], ["vec_id", "deviation", "w"])

    path = scratch_path(spark, "whitening")
    schema = T.StructType().add("vec_id", id_type).add("deviation", "long").add("w", T.ArrayType(T.DoubleType()))
    vectors.mapInArrow(projected, schema).write.parquet(path)
    flat = spark.read.parquet(path)
    error = identity_error(flat, many, centre.n)
    return flat.select(
        "vec_id", "deviation", F.posexplode("w").alias("at", "whitened")
    ).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation",
        "whitened", F.array(*[F.lit(float(v / trace)) for v in values])[F.col("at")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
