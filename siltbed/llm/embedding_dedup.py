"""Near-duplicate embeddings by binary codes of randomly rotated vectors.

A unit vector o is rotated by a fixed random rotation and stored as the signs of its coordinates, s / sqrt(D), with the
correction factor f = <s / sqrt(D), o>. For a rotated query q, <s / sqrt(D), q> / f estimates <o, q> without bias, and
its error exceeds EPSILON * sqrt((1 - f^2) / f^2) / sqrt(D - 1) only with a small probability that shrinks like a
Gaussian tail. The query side is rounded to four bits at random, without bias, so the bounds of a block and a chunk are
one product of small whole numbers and bits. Pairs whose upper confidence bound is below the threshold are done with; all others are recomputed exactly in
double precision, and only those links count.

Which pairs meet: a sample of the vectors, thinned so that no two are close, serves as centres (their number grows with
the table), and each vector lives with its nearest one, at the angle r. Of two vectors x and y within the angle t of the
threshold, let y be the one with the larger r: angles obey the triangle inequality, so y is within r(x) + t <= r(y) + t
of the home of x. Each vector therefore visits every centre within r + t of it whose residents can have such an r, and
every link is met, once, at the home of its vector with the smaller r. Neighbouring centres share a block of residents,
crowded ones have several; visitors of a block come in chunks of like size, and a block and a chunk are one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.components import connected_components
from siltbed.session import scratch_path

THRESHOLD = 0.95
PER_CENTRE = 128
MAX_CENTRES = 16_384  # bounds what is sampled and broadcast
CENTRE_SPACING = 0.8
BLOCK_ROWS = 1536  # least rows of a full block or chunk
BLOCK_SHARE = 8  # blocks and chunks grow with the table to this part of it, ...
BLOCK_BYTES = 1 << 24  # ... but no further than to so many bytes of vectors in double precision
SLACK = 1e-6  # of angles, above the rounding of cosines near 1
EPSILON = 4.0
QUERY_BITS = 4
SEED = 20_240_229


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of unit vectors, a bit for each coordinate, and their correction factors."""
    d = x.shape[1]
    turned = x @ rotation(d)
    bits = turned > 0
    factor = np.abs(turned).sum(axis=1) / np.sqrt(d)
    return np.packbits(bits, axis=1), factor


def words_of(packed: np.ndarray) -> np.ndarray:
    pad = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view(np.uint64)


class Query:
    """Rotated unit vectors, each coordinate rounded at random to QUERY_BITS bits between the row's extremes."""

    def __init__(self, x: np.ndarray, turn: np.ndarray | None = None):
        turned = x @ (rotation(x.shape[1]) if turn is None else turn)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**QUERY_BITS - 1), 1e-300)
        noise = np.random.default_rng(SEED).random(turned.shape)
        level = np.floor((turned - self.low[:, None]) / self.step[:, None] + noise)
        self.level = np.minimum(level, 2**QUERY_BITS - 1)
        self.sum = self.low * x.shape[1] + self.step * self.level.sum(axis=1)


def coded_side(codes: np.ndarray, factor: np.ndarray, d: int) -> np.ndarray:
    """What ``upper_bounds`` needs of coded vectors: bits, their number and the constant, over the factor, and the spread."""
    bits = np.unpackbits(codes.view(np.uint8), axis=1)[:, :d].astype(np.float64)
    spread = np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / np.sqrt(max(1, d - 1))
    return np.column_stack([
        np.column_stack([bits, bits.sum(axis=1), np.ones(len(bits))]) / factor[:, None], EPSILON * spread
    ])


def upper_bounds(query: Query, codes: np.ndarray, factor: np.ndarray, d: int, side: np.ndarray | None = None) -> np.ndarray:
    """Upper confidence bound of the inner product of each query (row) and each coded vector (column): one matrix product,
    as the bound is linear in the query's levels. ``side`` is the ``coded_side`` of the codes, if it is at hand."""
    # <s, q> = 2 * (sum of q over the set bits) - (sum of q over all)
    rounding = query.step * np.sqrt(d) / 2 / np.sqrt(d)  # the rounding of D coordinates, as one standard error
    own = np.column_stack([
        2 * query.step[:, None] * query.level, 2 * query.low, EPSILON * rounding - query.sum, np.full(len(query.sum), np.sqrt(d))
    ])
    return own / np.sqrt(d) @ (coded_side(codes, factor, d) if side is None else side).T


def local_roots(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n indices by the links rows-cols."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[rows], root[cols])
        now = root.copy()
        np.minimum.at(now, rows, least)
        np.minimum.at(now, cols, least)
        np.minimum.at(now, root[rows], least)
        np.minimum.at(now, root[cols], least)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def neighbours_first(x: np.ndarray) -> np.ndarray:
    """An order of unit vectors by repeated halving, so that parts of it lie close together."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= 2:
            done.append(own)
            continue
        far = x[own[np.argmin(x[own] @ x[own].mean(axis=0))]]
        other = x[own[np.argmin(x[own] @ far)]]
        own = own[np.argsort(x[own] @ (far - other), kind="stable")]
        todo += [own[len(own) // 2:], own[:len(own) // 2]]
    return np.concatenate(done)


class Layout:
    """Blocks of the residents of the centres of one length of vector, and chunks of those who visit them."""

    def __init__(self, centres: np.ndarray, crowds: pd.DataFrame):
        n = int(crowds["rows"].sum())
        size = max(BLOCK_ROWS, min(-(-n // BLOCK_SHARE), BLOCK_BYTES // (8 * centres.shape[1])))
        self.chunks = -(-n // size)
        rows = np.zeros(len(centres), np.int64)
        self.least, self.most = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
        at = crowds["home"].to_numpy()
        rows[at], self.least[at], self.most[at] = crowds["rows"], crowds["least"], crowds["most"]
        self.order = neighbours_first(centres)
        self.starts, held, many = [], [], []
        for i, m in enumerate(rows[self.order].tolist()):
            if not held or held[-1] + m > size:
                self.starts.append(i)
                held.append(0)
            held[-1] += m
        many = np.maximum(1, -(-np.array(held) // size))
        self.cells = np.repeat(np.arange(len(many)), many)  # the cell of centres that each block belongs to
        cell = np.empty(len(centres), np.int64)
        cell[self.order] = np.repeat(np.arange(len(many)), np.diff([*self.starts, len(centres)]))
        self.many, self.first = many[cell], (np.cumsum(many) - many)[cell]


def visits(layout: SimpleNamespace, angle: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Whether each vector may have a link to a resident of each block whose radius is no larger than its own."""
    able = (angle <= radius[:, None] + reach) & (layout.least <= radius[:, None]) & (angle - reach <= layout.most)
    return np.logical_or.reduceat(able[:, layout.order], layout.starts, axis=1)[:, layout.cells]


def compare_blocks(tile: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between a block and a chunk: counts for each vector, and a forest that joins what is linked.

    The vector with the larger radius (or, of equal ones, key) comes to the other's block, so a link counts there only.
    """
    d = int(tile["d"].iloc[0])
    x = units(tile["vector"])
    codes = words_of(np.frombuffer(b"".join(tile["code"]), np.uint8).reshape(len(tile), -1))
    factor = tile["factor"].to_numpy()
    resident = tile["resident"].to_numpy()
    rank = np.empty(len(tile), np.int64)
    rank[np.lexsort((tile["key"], tile["radius"]))] = np.arange(len(tile))
    left = np.flatnonzero(~resident | (tile["chunk"] == tile["at_chunk"]).to_numpy())
    right = np.flatnonzero(resident)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    turn, side = rotation(d), coded_side(codes[right], factor[right], d)
    many = max(1, (1 << 19) // max(1, len(right)))
    for at in range(0, len(left) if len(right) else 0, many):
        own = left[at:at + many]
        able = upper_bounds(Query(x[own], turn), codes[right], factor[right], d, side) >= threshold
        able &= rank[own][:, None] > rank[right][None, :]
        i, j = np.nonzero(able)
        if len(i) > able.size // 20:
            near = ((x[own] @ x[right].T) >= threshold)[i, j]
        else:
            near = np.einsum("ij,ij->i", x[own[i]], x[right[j]]) >= threshold
        links_a.append(own[i[near]])
        links_b.append(right[j[near]])
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    weight = tile["n"].to_numpy().astype(np.int64)
    counts = np.bincount(a, weight[b], len(tile)) + np.bincount(b, weight[a], len(tile))
    linked = np.flatnonzero(counts)
    keys = tile["key"].to_numpy()
    roots = local_roots(a, b, len(tile))
    return pd.DataFrame({
        "key": keys[linked], "links": counts[linked].astype(np.int64), "other": keys[roots[linked]],
    })


def prepared(rows: DataFrame) -> DataFrame:
    """Distinct usable vectors: key, vector (double), n (rows), first_id. Equal vectors are summed before the shuffle."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = v.isNotNull() & fine & F.exists(v, lambda x: x != 0)
    return rows.filter(usable).groupBy("key", "vector").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")
    )


def near_duplicates(
    table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``table``: its id, n_links, component_id, kept; other columns are not read.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths
    don't either. Equal vectors (and repeated rows) are one vector with a count, and all of them are linked. A row with
    a null id takes part, but names no component and isn't kept. An empty table gives no rows.
    """
    spark = table.sparkSession
    root = scratch_path(spark, "embeddings")
    as_double = F.col(vector).cast("array<double>")
    single = table.schema[vector].dataType.simpleString() == "array<float>"  # moved as such, half as large
    rows = table.select(F.col(id_column).alias("id"), (F.col(vector) if single else as_double).alias("vector"),
                        F.xxhash64(as_double).alias("key"))
    prepared(rows).withColumn("d", F.size("vector")).write.parquet(f"{root}/vectors")
    vectors = spark.read.parquet(f"{root}/vectors")
    n = vectors.count()

    # Centres: a bounded sample by hash, thinned.
    wanted = min(MAX_CENTRES, max(1, n // PER_CENTRE))
    scale = 1 << 30
    rate = min(scale, -(-scale * wanted // max(1, n)))
    picked = vectors.filter(F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(scale)) < rate).select("key", "vector", "d")
    chosen: dict[int, np.ndarray] = {}
    for d, group in picked.orderBy("key").toPandas().groupby("d"):
        x, kept = units(group["vector"]), []
        for i in range(len(x)):
            if not kept or (x[kept] @ x[i]).max() < CENTRE_SPACING:
                kept.append(i)
        chosen[int(d)] = x[kept]
    for (d,) in vectors.select("d").distinct().collect():
        chosen.setdefault(int(d), np.eye(1, int(d)))
    centres = spark.sparkContext.broadcast(chosen)  # at most about MAX_CENTRES vectors

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for d, batch in whole.groupby("d"):
                x = units(batch["vector"])
                code, factor = encode(x)
                home, radius = np.empty(len(x), np.int64), np.empty(len(x))
                for at in range(0, len(x), 1024):
                    angle = angles(x[at:at + 1024], centres.value[int(d)])
                    home[at:at + 1024], radius[at:at + 1024] = angle.argmin(axis=1), angle.min(axis=1)
                yield batch.assign(code=[c.tobytes() for c in code], factor=factor, home=home, radius=radius)

    fields = f"key long, n long, d int, vector {vectors.schema['vector'].dataType.simpleString()}, code binary, factor double"
    vectors.select("key", "n", "d", "vector").mapInPandas(
        placed, f"{fields}, home long, radius double"
    ).write.parquet(f"{root}/placed")
    homes = spark.read.parquet(f"{root}/placed")
    # One row per centre, at most MAX_CENTRES of them for each length of vector.
    crowds = homes.groupBy("d", "home").agg(
        F.count(F.lit(1)).alias("rows"), F.min("radius").alias("least"), F.max("radius").alias("most")
    ).toPandas()
    # As plain values: a broadcast doesn't carry classes of this package.
    layouts = spark.sparkContext.broadcast({
        int(d): SimpleNamespace(**vars(Layout(chosen[int(d)], own))) for d, own in crowds.groupby("d")
    })
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + SLACK

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for d, batch in whole.groupby("d"):
                layout, home = layouts.value[int(d)], batch["home"].to_numpy()
                mixed, radius = batch["key"].to_numpy().view(np.uint64), batch["radius"].to_numpy()
                block = layout.first[home] + (mixed >> np.uint64(32)).astype(np.int64) % layout.many[home]
                x, stops = units(batch["vector"]), []
                for at in range(0, len(x), 1024):
                    angle = angles(x[at:at + 1024], centres.value[int(d)])
                    able = visits(layout, angle, radius[at:at + 1024], reach)
                    able[np.arange(len(able)), block[at:at + 1024]] = False  # a resident there
                    stops += [np.flatnonzero(row) for row in able]
                chunk = (mixed & np.uint64(0xFFFFFFFF)).astype(np.int64) % layout.chunks
                yield batch.drop(columns="home").assign(chunk=chunk, block=block, chunks=layout.chunks, stops=stops)

    stays = homes.mapInPandas(dealt, f"{fields}, radius double, chunk int, block int, chunks int, stops array<int>")
    # Residents meet every chunk of visitors; visitors come with their own chunk.
    meetings = F.concat(
        F.transform("stops", lambda s: F.struct(s.alias("block"), F.col("chunk"), F.lit(False).alias("resident"))),
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(
            F.col("block"), j.alias("chunk"), F.lit(True).alias("resident"))),
    )
    tiles = stays.withColumn("meeting", F.explode(meetings)).select(
        "key", "n", "d", "vector", "code", "factor", "radius", "chunk", F.col("meeting.block").alias("at_block"),
        F.col("meeting.chunk").alias("at_chunk"), F.col("meeting.resident").alias("resident"),
    )
    schema = "key long, links long, other long"
    tiles.groupBy("d", "at_block", "at_chunk").applyInPandas(
        lambda tile: compare_blocks(tile, threshold), schema
    ).write.parquet(f"{root}/links")
    links = spark.read.parquet(f"{root}/links")

    component = connected_components(links.select(F.col("key").alias("a"), F.col("other").alias("b")))
    ids = vectors.select("key", "n", "first_id").join(component.withColumnRenamed("node", "key"), "key", "left")
    ids = ids.withColumn("component", F.coalesce("component", "key"))
    names = ids.groupBy("component").agg(F.min("first_id").alias("component_id"))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = ids.join(names, "component").join(counts, "key", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    return rows.select("id", "key").join(known, "key", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
    )
