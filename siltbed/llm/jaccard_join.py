"""Exact Jaccard join of word-shingle sets: size-banded tiles with hashed bitmap signatures.

Shingles have one order for the whole table: those frequent in a bounded sample last, else by hash. Two sets whose
Jaccard index reaches t share one of the first n - ceil(t n) + 1 shingles of each, so sets meet in tiles: one tile for
each such shingle and band of sizes, where a band reaches as far as t allows. (The order only moves work; any order
gives the same links.) In a tile, a set's signature has some bits for each shingle; the bits in which two signatures
differ are at most the shingles in which the sets differ, which bounds their overlap from above. Sets that have a
pair which passes meet again with their arrays, and such pairs are intersected exactly as sorted arrays.

Groups of copies are settled before tiles compare pairs: equal sets are one set, and in each tile sets are first
compared with a few pivots only. Afterwards only sets of different components are compared, so a group of near copies
costs about as many comparisons as it has members, and tiles that hold one component, or the same sets as another tile, are
dropped. Larger tiles are dealt into blocks, and each pair of blocks is one group, in which exact links join components as they
are found: what a group puts out grows with its sets, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed import storage
from siltbed.llm.batches import bounded_batches
from siltbed.llm.bitsets import marked, may_hold
from siltbed.llm.components import connected_components
from siltbed.llm.shingles import mixed, shingle_sets
from siltbed.session import scratch_path

SAMPLE_TEXTS = 8192
MAX_FREQUENT = 65_536
#: Sets of a block: at most so many, fewer of large ones so that their arrays take no more than so many bytes.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_LEAST = 512, 1 << 25, 8
MIN_BITS = 64
BITS_PER_SHINGLE = 4
#: Rounds of comparing with pivots, one pivot for so many sets of a tile, and how many at most.
STAR_TURNS, SETS_PER_PIVOT, MOST_PIVOTS = 2, 8, 16
BATCH_ROWS = 256


def needed(total, percent: int):
    """Least overlap of two sets with ``total`` elements together: 100 * o >= percent * (total - o)."""
    return -(-percent * total // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def signature(hashes: np.ndarray) -> bytes:
    """BITS_PER_SHINGLE bits for each shingle, up to a power of two; bit h mod size is set for each hash h."""
    bits = max(MIN_BITS, 1 << int(len(hashes) * BITS_PER_SHINGLE - 1).bit_length())
    field = np.zeros(bits, np.uint8)
    field[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(field, bitorder="little").tobytes()


def set_id(hashes: np.ndarray) -> int:
    return int(mixed(np.array([mixed(hashes).sum() + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For two object arrays of signatures, in how many bits each pair differs, after folding the longer one."""
    out = np.zeros(len(a), np.int64)
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    for size_a, size_b in set(zip(la.tolist(), lb.tolist())):
        own = np.flatnonzero((la == size_a) & (lb == size_b))
        least = min(size_a, size_b)
        for at in range(0, len(own), max(1, (8 << 20) // max(size_a, size_b))):
            part = own[at:at + max(1, (8 << 20) // max(size_a, size_b))]
            x = np.frombuffer(b"".join(a[part]), np.uint64).reshape(len(part), size_a // least, least // 8)
            y = np.frombuffer(b"".join(b[part]), np.uint64).reshape(len(part), size_b // least, least // 8)
            out[part] = np.bitwise_count(np.bitwise_or.reduce(x, 1) ^ np.bitwise_or.reduce(y, 1)).sum(1)
    return out


def may_link(na, nb, sa, sb, percent: int) -> np.ndarray:
    """Whether size and signature leave room for the needed overlap, for arrays of pairs."""
    total, want = na + nb, needed(na + nb, percent)
    able = np.minimum(na, nb) >= want
    at = np.flatnonzero(able)
    able[at] = (total[at] - differing_bits(sa[at], sb[at])) // 2 >= want[at]
    return able


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that at least three texts of a bounded sample hold, the most frequent MAX_FREQUENT at most; sorted."""
    n = docs.count()
    scale = 1 << 30
    rate = min(scale, -(-scale * SAMPLE_TEXTS // max(1, n)))
    sample = docs.filter(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(scale)) < rate).dropDuplicates(["key"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for h in shingle_sets(batch.column("text"), width)]
            hashes, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["hash", "n"])

    rows = sample.select("text").mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rows = rows.filter("n >= 3").orderBy(F.desc("n"), "hash").limit(MAX_FREQUENT).collect()
    return np.sort(np.array([r.hash for r in rows], np.int64).view(np.uint64))


def _linked(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose sorted arrays overlap enough."""

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["hashes_a"], batch["hashes_b"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.loc[good, ["a", "b"]]

    left = arrays.select(F.col("set_id").alias("a"), F.col("hashes").alias("hashes_a"))
    right = arrays.select(F.col("set_id").alias("b"), F.col("hashes").alias("hashes_b"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(exact, "a long, b long")


def _by_tile(batches: Iterator[pd.DataFrame], each) -> Iterator[pd.DataFrame]:
    """``each`` of whole tiles, for rows that arrive sorted by tile; a tile that a batch cuts off is carried to the next."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        tile = rows["tile"].to_numpy()
        cut = int(np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))[-1])
        rest = rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield each(rows.iloc[:cut].reset_index(drop=True))
    if rest is not None and len(rest):
        yield each(rest)


def _candidates(rows: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same tile (sorted by tile) whose components differ and whose sizes and signatures may link."""
    tile = rows["tile"].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    ends = np.append(starts[1:], len(rows))
    n, component, sign = rows["n"].to_numpy(), rows["component"].to_numpy(), rows["signature"].to_numpy()
    side, member = rows["side"].to_numpy(), rows["member"].to_numpy()
    pending, size = [], 0

    def able() -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(p) for p in zip(*pending))
        good = may_link(n[i], n[j], sign[i], sign[j], percent)
        return i[good], j[good]

    for first, last in zip(starts.tolist(), ends.tolist()):
        for at in range(first, last, 256):
            top = min(at + 256, last)
            i, j = (x.ravel() for x in np.meshgrid(np.arange(at, top), np.arange(first, last), indexing="ij"))
            # Sides 1 and 2 are the two blocks of a pair of blocks; side 0 is a tile in one block.
            fine = (component[i] != component[j]) & (member[i] | member[j])
            fine &= ((i < j) & (side[i] == 0)) | ((side[i] == 1) & (side[j] == 2))
            fine &= np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])
            if fine.any():
                pending.append((i[fine], j[fine]))
                size += int(fine.sum())
            if size > 1 << 18:
                yield able()
                pending, size = [], 0
    if pending:
        yield able()


def _with_candidates(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows that have a candidate in their tile, without signatures: never more rows than came."""
    met = np.zeros(len(rows), bool)
    for i, j in _candidates(rows, percent):
        met[i] = met[j] = True
    return rows.loc[met, ["tile", "set_id", "component", "member", "side"]]


def _linked_in_tiles(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join what is linked in each tile, by exact intersection of the candidates' arrays.

    Only components matter, so a pair that earlier links of the tile connect already is passed over, and a tile gives
    fewer links than it has sets.
    """
    arrays = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
    rows = rows.drop(columns="hashes").assign(n=[len(x) for x in arrays], signature=[signature(x) for x in arrays])
    ids, tile, component = rows["set_id"].to_numpy(), rows["tile"].to_numpy(), rows["component"].to_numpy()
    # Sets of one component of a tile are connected to begin with.
    _, root = np.unique(np.column_stack([tile, component]), axis=0, return_inverse=True)
    root = root.ravel().tolist()
    parent = list(range(max(root) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for left, right in _candidates(rows, percent):
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = find(root[i]), find(root[j])
            if a == b:
                continue
            x, y = arrays[i], arrays[j]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                parent[b] = a
                links.append((ids[i], ids[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def jaccard_groups(
    docs: DataFrame, width: int = 4, percent: int = 85, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (xxhash64 of the text), n_shingles, component (a number, null without
    shingles), component_id; other columns are not read.

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of shingles of ``width`` words (ASCII lower
    case; a shorter text is one shingle). Null, empty and blank texts have no shingles and link with nothing, not even
    each other; equal sets always link. component_id is the smallest id reachable; null ids take part but name no
    component, so a component of null ids alone has a null one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    root = scratch_path(spark, "jaccard")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    def done_with(*names: str) -> None:
        for name in names:
            storage.delete_tree(spark, f"{root}/{name}")

    keyed = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    frequent = spark.sparkContext.broadcast(_frequent(keyed.select("key", "text"), width))  # at most MAX_FREQUENT values

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                ids, sizes, prefixes, signs = [], [], [], []
                for h in shingle_sets(batch.column("text"), width):
                    n = len(h)
                    sizes.append(n)
                    ids.append(set_id(h) if n else None)
                    signs.append(signature(h) if n else None)
                    if n and len(common):
                        late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                        h = np.concatenate([h[~late], h[late]])
                    prefixes.append(h[:prefix_length(n, percent)].view(np.int64) if n else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(prefixes, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                    ["doc_id", "key", "set_id", "n", "prefix", "signature"],
                )

    id_type = keyed.schema["doc_id"].dataType.simpleString()
    rows = kept(keyed.mapInArrow(
        profiled, f"doc_id {id_type}, key long, set_id long, n long, prefix array<long>, signature binary"
    ).withColumn("at", F.xxhash64(F.monotonically_increasing_id())), "rows")
    sets = kept(rows.filter("n > 0").groupBy("set_id").agg(
        F.min("key").alias("key"), F.min("n").alias("n"), F.min("at").alias("at")
    ), "sets")
    # One row for each set (and a few more) is marked; copies go no further.
    first = spark.sparkContext.broadcast(marked(sets, "at", sets.count()))  # 32 MB at most

    # Tiles: shingles of a prefix that at least two sets share.
    entries = rows.filter("n > 0").select("set_id", "n", F.explode("prefix").alias("shingle"))
    shared = kept(entries.groupBy("shingle").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).filter("x <> y")
                  .select("shingle"), "shared")
    field = spark.sparkContext.broadcast(marked(shared, "shingle", shared.count()))  # 32 MB at most

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(may_hold(first.value, whole.column("at").to_numpy())))
            prefix = batch.column("prefix")
            lengths = np.diff(prefix.offsets.to_numpy())
            flat = prefix.flatten().to_numpy()
            may = may_hold(field.value, flat)
            owner = np.repeat(np.arange(batch.num_rows), lengths)[may]
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_id").take(pa.array(owner)), batch.column("n").take(pa.array(owner)), pa.array(flat[may])],
                ["set_id", "n", "shingle"],
            )

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    entries = rows.filter("n > 0").select("set_id", "n", "prefix", "at").mapInArrow(meeting, "set_id long, n long, shingle long")
    entries = kept(entries.join(shared, "shingle").distinct().withColumn("band", band), "entries")
    done_with("shared")

    def arrays_of(pairs: DataFrame, name: str) -> DataFrame:
        """Sorted shingle arrays of the sets in ``pairs``, read again from the texts; only marked texts are cut up."""
        wanted = kept(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
                      .join(sets.select("set_id", "key"), "set_id"), f"{name}_wanted")
        marks = spark.sparkContext.broadcast(marked(wanted, "key", wanted.count()))  # 32 MB at most

        def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                may = may_hold(marks.value, whole.column("key").to_numpy())
                chosen = whole.filter(pa.array(may))
                for at in range(0, chosen.num_rows, BATCH_ROWS):
                    batch = chosen.slice(at, BATCH_ROWS)
                    found = [h.tobytes() for h in shingle_sets(batch.column("text"), width)]
                    yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], ["key", "hashes"])

        found = keyed.select("key", "text").mapInArrow(cut_up, "key long, hashes binary")
        return kept(found.join(wanted, "key").dropDuplicates(["set_id"]).select("set_id", "hashes"), f"{name}_arrays")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        links = kept(_linked(pairs, arrays_of(pairs, name), percent), f"{name}_links")
        done_with(f"{name}_wanted", f"{name}_arrays")
        return links

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c = {k: batch[k].to_numpy() for k in ("na", "nb", "sa", "sb")}
            yield batch.loc[may_link(c["na"], c["nb"], c["sa"], c["sb"], percent), ["a", "b"]]

    sizes = {x: sets.select(F.col("set_id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab"}

    # A set also visits the next band's tile. Tiles of the same sets are one tile, and those of one set none.
    visiting = entries.withColumn("member", F.lit(True)).union(
        entries.withColumns({"band": F.col("band") + 1, "member": F.lit(False)}).select(*entries.columns, "member"))
    tiles = visiting.groupBy("shingle", "band").agg(
        F.count(F.lit(1)).alias("sets"), F.min(F.when(F.col("member"), F.col("n"))).alias("least"),
        F.sum(F.xxhash64("set_id", "member").cast("decimal(38,0)")).alias("sum_sets"),
    ).filter("least is not null and sets > 1")
    distinct = tiles.groupBy("sum_sets", "sets").agg(F.min(F.struct("shingle", "band", "least")).alias("t"))
    # Visitors too small for the smallest member link with none.
    reach = F.col("member") | (F.col("n") * 100 >= percent * F.col("least"))
    visiting = kept(visiting.join(distinct.select("t.*", "sets"), ["shingle", "band"]).filter(reach).select(
        F.xxhash64("shingle", "band").alias("tile"), "band", "sets", "set_id", "n", "member"), "visiting")
    done_with("entries")
    met_sets = sets.select("at", "set_id").join(visiting.select("set_id").distinct(), "set_id")
    signs = kept(rows.select("at", "signature").join(met_sets, "at").select("set_id", "signature"), "signatures")
    # The prefixes and the signatures of all rows have been used.
    rows = kept(rows.select("doc_id", "key", "n", "set_id"), "members")
    done_with("rows")
    sign = {x: signs.select(F.col("set_id").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab"}

    def named(component: DataFrame | None) -> DataFrame:
        if component is None:
            return visiting.withColumn("component", F.col("set_id"))
        return visiting.join(component, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))

    # First one set of each component in a tile with the tile's pivots: the sets nearest to some fixed random values, so
    # tiles of similar sets have the same pivots. A tile has more of them the more sets it holds, up to a fixed number.
    component, links = None, None
    for turn in range(STAR_TURNS):
        rng = np.random.default_rng(turn)
        values = [int(v) for v in rng.integers(-(1 << 63), (1 << 63) - 1, MOST_PIVOTS)]
        near = [
            F.min(F.when(F.col("sets") > SETS_PER_PIVOT * i, F.col("set_id").bitwiseXOR(F.lit(v)))).bitwiseXOR(F.lit(v))
            for i, v in enumerate(values)
        ]
        here = named(component)
        pivots = here.groupBy("tile").agg(
            F.min("component").alias("x"), F.max("component").alias("y"), F.array_distinct(F.array_compact(F.array(*near))).alias("pivots"),
        ).filter("x <> y").select("tile", "pivots")
        one = here.groupBy("tile", "component").agg(F.min("set_id").alias("set_id"))
        stars = one.join(pivots, "tile").select("set_id", F.explode("pivots").alias("pivot")).filter(
            "set_id <> pivot").select(F.least("set_id", "pivot").alias("a"), F.greatest("set_id", "pivot").alias("b")).distinct()
        stars = stars.join(sizes["a"], "a").join(sizes["b"], "b").filter(
            F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb"))
        stars = stars.join(sign["a"], "a").join(sign["b"], "b").mapInPandas(bounded, "a long, b long")
        found = verified(kept(stars, f"stars{turn}"), f"stars{turn}_exact")
        links = found if links is None else links.union(found)
        done_with(f"stars{turn}")
        component = kept(connected_components(links).withColumnRenamed("node", "set_id"), f"components{turn}")

    # Then the tiles, among sets that are not connected yet: which sets have a candidate there, by signatures, ...
    here = named(component)
    mixed_tiles = here.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    array_bytes = F.pow(F.lit(100.0 / percent), F.col("band") + 1) * 8
    block_rows = F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / array_bytes)))
    dealt = here.join(mixed_tiles.select("tile"), "tile").withColumn("blocks", F.ceil(F.col("sets") / block_rows).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("tile", F.least("block", "with"), F.greatest("block", "with")).alias("tile"),
        "set_id", "n", "component", "member",
        F.when(F.col("block") == F.col("with"), 0).when(F.col("block") < F.col("with"), 1).otherwise(2).alias("side"),
    )
    dealt = dealt.join(signs, "set_id")
    met = kept(dealt.repartition("tile").sortWithinPartitions("tile").mapInPandas(
        lambda batches: _by_tile(batches, lambda rows: _with_candidates(rows, percent)),
        "tile long, set_id long, component long, member boolean, side int",
    ), "met")
    # ... and then exactly, with the arrays of those sets at hand; tiles in which the same sets are left are one.
    left = met.groupBy("tile").agg(
        F.count(F.lit(1)).alias("sets"), F.sum(F.xxhash64("set_id", "member", "side").cast("decimal(38,0)")).alias("sum_sets")
    ).groupBy("sum_sets", "sets").agg(F.min("tile").alias("tile")).select("tile")
    met = met.join(left, "tile")
    arrays = arrays_of(met.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")), "met")
    second = kept(met.join(arrays, "set_id").repartition("tile").sortWithinPartitions("tile").mapInPandas(
        lambda batches: _by_tile(batches, lambda rows: _linked_in_tiles(rows, percent)), "a long, b long"), "second")
    done_with("met", "met_wanted", "met_arrays", "visiting", "signatures")

    final = connected_components(links.union(second)).withColumnRenamed("node", "set_id")
    by_set = rows.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    by_set = by_set.join(final, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    names = by_set.groupBy("component").agg(F.min("least").alias("component_id"))
    known = by_set.join(names, "component").select("set_id", "component", "component_id")
    return rows.select("doc_id", "key", "n", "set_id").join(known, "set_id", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, **names: str) -> DataFrame:
    """doc_id, n_shingles and component_id of :func:`jaccard_groups`."""
    return jaccard_groups(docs, width, percent, **names).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(
    docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group that links join: the one with the smallest id (null last), then text hash.

    Rows without shingles are all kept; of repeated rows one is. Only rows that go, or stand twice, are shuffled.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "groups")
    jaccard_groups(docs, width, percent, id_column, text).filter("n_shingles > 0").groupBy("component", "doc_id", "key").agg(
        F.count(F.lit(1)).alias("n")
    ).write.parquet(f"{root}/members")
    members = spark.read.parquet(f"{root}/members")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    chosen = members.groupBy("component").agg(F.min(order).alias("best"))
    lone = members.join(chosen, "component").withColumn(
        "best", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key")))
    lone.filter((F.col("n") > 1) | ~F.col("best")).select(
        "doc_id", "key", "best", F.xxhash64("doc_id", "key").alias("row")
    ).write.parquet(f"{root}/marked")
    special = spark.read.parquet(f"{root}/marked")
    field = spark.sparkContext.broadcast(marked(special, "row", special.count()))  # 32 MB at most

    @F.pandas_udf(T.BooleanType())
    def may_go(rows: pd.Series) -> pd.Series:
        return pd.Series(may_hold(field.value, rows.to_numpy()))

    names = docs.columns
    keyed = docs.withColumns({"__key": F.xxhash64(F.col(text)), "__row": F.xxhash64(F.col(id_column), F.xxhash64(F.col(text)))})
    keyed = keyed.withColumn("__may", may_go("__row"))
    same = special.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__same"), "best", F.col("row").alias("__row"))
    looked_up = keyed.filter("__may").join(same, "__row", "left")
    looked_up = looked_up.filter("best is null or best")
    twice = looked_up.filter("best").dropDuplicates(["__row"])
    return keyed.filter(~F.col("__may")).select(*names).union(looked_up.filter("best is null").select(*names)).union(twice.select(*names))
