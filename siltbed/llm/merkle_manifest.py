"""A Merkle manifest of a table as a nested-struct rollup.

Leaves are hashes of rows. Within a tree (one for each value of a grouping column) they are ranked, and the rank is read
as digits of base 16. Three digits make a bounded block of at most 4096 nodes; inside a block the digits are grouped away
one after the other, each time nesting the child structs in their parent, after a single exchange by (tree, block).
Blocks are the nodes of the next round, so a round shrinks the table 4096 times. On the way down, the path above a
block meets the block's nested struct as one more row of its group, and transforms and explodes of the struct give each
node its siblings; nothing is joined with the leaves. The roots of the trees are the leaves of a last tree.

A source that holds a third of all rows is cut into blocks like any other; no task holds more than some blocks. Ranks
come from a range partitioning: the place inside a sorted partition, plus what earlier partitions hold of the tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import scratch_path

DIGIT_BITS = 4
FAN_OUT = 1 << DIGIT_BITS
BLOCK_DIGITS = 3
BLOCK = FAN_OUT**BLOCK_DIGITS
PLACE_BITS = 33  # of monotonically_increasing_id, the rest is the partition


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Hash of the fields in order, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _ranked(nodes: DataFrame, path: str) -> DataFrame:
    """``nodes`` (tree, place, h, ...) with their rank by (place, h) in their tree and the tree's size ``of``."""
    sorted_nodes = nodes.repartitionByRange("tree", "place", "h").sortWithinPartitions("tree", "place", "h")
    sorted_nodes.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    nodes = nodes.sparkSession.read.parquet(path)
    part = F.shiftright("at", PLACE_BITS)
    # One row for each tree and partition it lies in: no more than partitions and trees together.
    stretches = nodes.groupBy(F.col("tree").alias("own"), part.alias("part")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n")
    )
    tree = Window.partitionBy("own")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(
        "own", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(tree).alias("of")
    )
    rank = F.col("before") + F.col("at") - F.col("first")
    return (
        nodes.withColumn("in_part", part)
        .join(stretches, F.col("tree").eqNullSafe(F.col("own")) & (F.col("in_part") == F.col("part")))
        .select(*[c for c in nodes.columns if c != "at"], rank.alias("rank"), "of")
    )


def _nested(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """One row per block of ranked nodes: tree, of, block, its hash and the nested structs of its nodes."""
    digits = [f"digit{i}" for i in range(BLOCK_DIGITS)]
    place = [
        F.shiftright("rank", DIGIT_BITS * i).bitwiseAND(F.lit(FAN_OUT - 1)).cast("int").alias(d) for i, d in enumerate(digits)
    ]
    block = F.shiftright("rank", DIGIT_BITS * BLOCK_DIGITS).alias("block")
    rows = nodes.select("tree", "of", block, *place, "h", *carried).repartition("tree", "block")
    inner = list(carried)
    for level, digit in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(digit, "h", *inner)))
        rows = rows.groupBy("tree", "of", "block", *digits[level + 1:]).agg(kids.alias("kids"))
        own = F.when(
            F.col("of") > FAN_OUT**level, F.sha2(F.array_join(F.transform("kids", lambda k: k["h"]), ""), 256)
        ).otherwise(F.col("kids")[0]["h"])  # a tree that is one node already
        rows = rows.withColumn("h", own)
        inner = ["kids"]
    return rows


def _rolled_up(nodes: DataFrame, path: str, carried: Sequence[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds of nested blocks from the leaves up, and for each round the (tree, h) of the trees it completed."""
    spark, rounds, complete = nodes.sparkSession, [], []
    while not rounds or not nodes.isEmpty():
        _nested(nodes, () if rounds else carried).write.parquet(f"{path}/{len(rounds)}")
        blocks = spark.read.parquet(f"{path}/{len(rounds)}")
        rounds.append(blocks)
        complete.append(blocks.filter(F.col("of") <= BLOCK).select("tree", "h"))
        nodes = blocks.filter(F.col("of") > BLOCK).select(
            "tree", "h", F.col("block").alias("rank"), F.ceil(F.col("of") / BLOCK).cast("long").alias("of")
        )
    return rounds, complete


def _opened(blocks: DataFrame, above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """One row per node of ``blocks``: tree, rank, h, what is ``carried``, and the path to the root of all.

    ``above`` has one row for each block: tree, block, path (subroot and steps). A block's row and its path meet in one
    group; a step holds the hashes left and right of a node in its run.
    """
    own = F.struct("of", "kids")
    met = (
        blocks.select("tree", "block", own.alias("own"), F.lit(None).cast(above.schema["path"].dataType).alias("path"))
        .unionByName(above.select("tree", "block", F.lit(None).cast(blocks.select(own.alias("o")).schema["o"].dataType).alias("own"), "path"))
        .groupBy("tree", "block")
        .agg(F.first("own", ignorenulls=True).alias("own"), F.first("path", ignorenulls=True).alias("path"))
    )
    rows = met.select(
        "tree", F.col("block").alias("rank"), F.col("own.of").alias("of"), F.col("path.subroot").alias("subroot"),
        F.col("path.steps").alias("steps"), F.col("own.kids").alias("kids"),
    )
    for level in reversed(range(BLOCK_DIGITS)):
        rows = rows.select(
            "tree", "rank", "of", "subroot", "steps", F.transform("kids", lambda k: k["h"]).alias("run"),
            F.posexplode("kids").alias("i", "kid"),
        )
        step = F.struct(
            F.array_join(F.slice("run", F.lit(1), F.col("i")), "").alias("left"),
            F.array_join(F.slice("run", F.col("i") + 2, F.lit(FAN_OUT)), "").alias("right"),
        )
        inner = [F.col("kid.kids")] if level else [F.col("kid.h"), *(F.col(f"kid.{c}") for c in carried)]
        rows = rows.select(
            "tree", (F.col("rank") * FAN_OUT + F.col("i")).alias("rank"), "of", "subroot",
            F.when(F.col("of") > FAN_OUT**level, F.concat(F.array(step), F.col("steps"))).otherwise(F.col("steps")).alias("steps"),
            *inner,
        )
    return rows.drop("of")


def _with_paths(rounds: list[DataFrame], trees: list[DataFrame], carried: Sequence[str]) -> DataFrame:
    """Every leaf with its path; ``trees`` has, for each round, (tree, path) of the trees completed in it."""
    below = None
    for i in reversed(range(len(rounds))):
        above = trees[i].select("tree", F.lit(0).cast("long").alias("block"), "path")
        if below is not None:
            above = above.unionByName(
                below.select("tree", F.col("rank").alias("block"), F.struct("subroot", "steps").alias("path"))
            )
        below = _opened(rounds[i], above, () if i else carried)
    return below


def manifest(
    rows: DataFrame, fields: Sequence[str], id_column: str = "doc_id", tree_column: str = "source",
    altered: Column | None = None,
) -> DataFrame:
    """One row per row of ``rows``: tree, place, leaf, subroot, root, steps, proof_sha256, folded_root, verified.

    The leaf is the hash of ``fields``. Per value of ``tree_column`` (null is one of them) leaves ascend by ``id_column``
    (null first, equal ids by leaf); runs of 16 nodes become their hash until one is left, the subroot. Subroots in
    ascending order of the tree's value (null first) likewise give the root. ``steps`` is the proof, from the leaf up:
    hashes left and right of the path's node in its run. ``altered`` is a leaf hash put in the leaf's place to be
    verified (null: the leaf itself): ``folded_root`` is what the steps make of it, ``verified`` whether that is the root.

    Null fields, empty and long texts have their leaf by the rule above; repeated rows are leaves of their own; an
    empty table has no rows; columns other than those named are not read. Scratch tables hold hashes and ids, no texts.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "manifest")
    rows.select(
        F.col(tree_column).alias("tree"), F.col(id_column).alias("place"),
        leaf_hash([F.col(f) for f in fields]).alias("h"),
        (F.lit(None) if altered is None else altered).cast("string").alias("altered"),
    ).write.parquet(f"{path}/leaves")
    leaves = spark.read.parquet(f"{path}/leaves")
    rounds, complete = _rolled_up(_ranked(leaves, f"{path}/ranked"), f"{path}/rounds", ("place", "altered"))

    # The tree of trees: its leaves are subroots, and each remembers in which round its tree was complete.
    subroots = complete[0].withColumn("round", F.lit(0))
    for i, done in enumerate(complete[1:], 1):
        subroots = subroots.unionByName(done.withColumn("round", F.lit(i)))
    tops = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("place"), "h", "round")
    top_rounds, top_complete = _rolled_up(_ranked(tops, f"{path}/tops"), f"{path}/top-rounds", ("place", "round"))
    crown = F.struct(F.lit(None).cast("string").alias("subroot"), F.array().cast("array<struct<left:string,right:string>>").alias("steps"))
    top_paths = _with_paths(top_rounds, [c.select("tree", crown.alias("path")) for c in top_complete], ("place", "round"))
    top_paths.write.parquet(f"{path}/paths")
    paths = spark.read.parquet(f"{path}/paths")
    tree_path = F.struct(F.col("h").alias("subroot"), "steps")
    trees = [
        paths.filter(F.col("round") == i).select(F.col("place").alias("tree"), tree_path.alias("path"))
        for i in range(len(rounds))
    ]
    found = top_complete[-1].first()  # one row, or none of an empty table
    root = F.lit(found.h if found else None).cast("string")

    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate(
        "steps", F.coalesce("altered", "h"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256)
    )
    return (
        _with_paths(rounds, trees, ("place", "altered"))
        .select(
            "tree", "place", F.col("h").alias("leaf"), "subroot", root.alias("root"), "steps",
            F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
