"""Removal of byte strings that occur twice or more, by merged shard Burrows-Wheeler transforms.

Windows of ``length`` bytes that are equal have equal anchors (see ``anchors``), so only stretches of windows whose
anchor occurs elsewhere can hold repeats, and stretches with different anchors never share one. Equal stretches are
one with a count. A stretch whose anchor has no other stretch needs no look inside: if it occurs twice, all its windows
do. All others are dealt by anchor into groups of about half a megabyte; each group is cut into shards whose transforms are
merged, and the intervals of the merge tell which windows occur twice. An anchor with more than HOT_STRETCHES different
stretches is split by window instead: its windows' hashes are counted over the whole table, which needs no group.
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
from siltbed.llm.anchors import stretches, window_hashes
from siltbed.llm.batches import bounded_batches
from siltbed.llm.bitsets import marked, may_hold
from siltbed.llm.bwt_merge import repeated_starts
from siltbed.session import scratch_path

LENGTH = 400
GROUP_BYTES = 1 << 19
HOT_STRETCHES = 1024
REMEMBERED = 1 << 16  # keys of texts that a task knows to have lifted already


def bytes_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for text in texts:
        yield np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def merged_runs(stretch: pd.DataFrame, counts: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of repeated window starts of the stretches of one group, which arrive with their bytes and their counts."""
    both = stretch.merge(counts, on=["anchor", "whole"])
    found = repeated_starts(both["bytes"].tolist(), both["n"].to_numpy(), length)
    out = []
    for anchor, whole, flags in zip(both["anchor"], both["whole"], found):
        out += [(anchor, whole, a, b) for a, b in zip(*(x.tolist() for x in runs(flags)))]
    return pd.DataFrame(out, columns=["anchor", "whole", "low", "high"], dtype="int64")


def repeated_spans(docs: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """(key, spans) of the texts that hold repeats; spans are the (first, end) bytes of maximal covered runs, sorted.

    ``key`` must be the same for equal texts and differ for different ones.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    root = scratch_path(spark, "suffixes")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    def done_with(*names: str) -> None:
        for name in names:
            storage.delete_tree(spark, f"{root}/{name}")

    long_enough = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") >= length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [stretches(data, length) for data in bytes_of(batch.column("text"))]
            if not parts:
                continue
            many = [len(p[0]) for p in parts]
            anchor, whole, first, windows = (np.concatenate(c) for c in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(np.repeat(np.arange(len(parts)), many))), pa.array(anchor.view(np.int64)),
                 pa.array(whole.view(np.int64)), pa.array(first), pa.array(windows.astype(np.int32))],
                ["key", "anchor", "whole", "first", "windows"],
            )

    rows = kept(long_enough.mapInArrow(cut, "key long, anchor long, whole long, first long, windows int"), "rows")
    anchors = kept(rows.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("whole").alias("x"), F.max("whole").alias("y")
    ).filter("n > 1").select("anchor", (F.col("x") != F.col("y")).alias("several")), "anchors")
    field = spark.sparkContext.broadcast(marked(anchors, "anchor", anchors.count()))  # 32 MB at most

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(field.value, batch.column("anchor").to_numpy())))

    rows = kept(rows.mapInArrow(meeting, rows.schema).join(anchors, "anchor"), "meeting")
    done_with("rows", "anchors")
    groups = kept(rows.filter("several").groupBy("anchor", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("windows").alias("windows")
    ), "stretches")
    crowds = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT_STRETCHES).select(
        "anchor", F.lit(True).alias("hot"))
    groups = kept(groups.join(crowds, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "groups")
    done_with("stretches")
    total = groups.agg(F.sum(F.col("windows") + length), F.count(F.lit(1))).first()
    size, n_groups = total[0] or 0, total[1]
    dealt = F.pmod(F.col("anchor"), F.lit(max(1, -(-size // GROUP_BYTES))))

    # The bytes of one occurrence of each stretch, from the texts that are marked to hold one.
    own = F.col("whole").bitwiseXOR(F.col("key"))
    texts = spark.sparkContext.broadcast(marked(groups, "key", n_groups))  # 32 MB at most, both
    chosen = spark.sparkContext.broadcast(marked(groups.select(own.alias("own")), "own", n_groups))

    def lifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(texts.value, batch.column("key").to_numpy())))
            found = []
            for k, data in zip(batch.column("key").to_numpy(), bytes_of(batch.column("text"))):
                if int(k) in done:
                    continue
                if len(done) == REMEMBERED:
                    done.clear()
                done.add(int(k))
                anchor, whole, first, windows = (c.astype(np.int64) for c in stretches(data, length))
                for i in np.flatnonzero(may_hold(chosen.value, whole ^ k)).tolist():
                    found.append((int(anchor[i]), int(whole[i]), data[first[i]:first[i] + windows[i] + length - 1].tobytes()))
                    if len(found) == 8192:
                        yield pa.RecordBatch.from_pylist([dict(zip(("anchor", "whole", "bytes"), f)) for f in found])
                        found = []
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(("anchor", "whole", "bytes"), f)) for f in found])

    # Copies of a text in different tasks lift the same stretches; one of each goes on.
    lifts = kept(long_enough.mapInArrow(lifted, "anchor long, whole long, bytes binary").dropDuplicates(["anchor", "whole"]), "lifts")
    usual = groups.filter(~F.col("hot")).select("anchor", "whole", "n", dealt.alias("group"))
    found = lifts.withColumn("group", dealt).groupBy("group").cogroup(usual.groupBy("group")).applyInPandas(
        lambda left, right: merged_runs(left, right, length), "anchor long, whole long, low long, high long"
    )

    # Crowded anchors: every window by two independent 64-bit hashes, counted with its stretch's count.
    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = list(bytes_of(batch.column("bytes")))
            hashes = [(window_hashes(d, length, 0), window_hashes(d, length, 1)) for d in data]
            many = [len(h) for h, _ in hashes]
            take = pa.array(np.repeat(np.arange(len(data)), many))
            if not len(take):
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("anchor", "whole", "n")]
                + [pa.array(np.concatenate([np.arange(m) for m in many]))]
                + [pa.array(np.concatenate([h[i] for h in hashes]).view(np.int64)) for i in (0, 1)],
                ["anchor", "whole", "n", "low", "h1", "h2"],
            )

    crowded = groups.filter("hot").select("anchor", "whole", "n")
    if crowded.limit(1).count():
        windows = kept(lifts.join(crowded, ["anchor", "whole"]).select(
            "anchor", "whole", "n", "bytes").mapInArrow(windows_of, "anchor long, whole long, n long, low long, h1 long, h2 long"), "crowded")
        twice = windows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1").select("h1", "h2")
        found = found.union(windows.join(twice, ["h1", "h2"]).select("anchor", "whole", "low", F.col("low").alias("high")))
    found = kept(found, "found")
    done_with("lifts", "crowded", "groups")

    whole_ones = rows.filter(~F.col("several")).select(
        "key", "first", (F.col("first") + F.col("windows") - 1 + length).alias("end"))
    parts = rows.filter("several").select("key", "first", "anchor", "whole").join(found, ["anchor", "whole"]).select(
        "key", (F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.col("high") + length).alias("end"))
    spans = whole_ones.union(parts).distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    # Neighbouring and overlapping spans of a text as one.
    joined = F.aggregate(
        "spans", F.struct(none.alias("done"), F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("end")),
        lambda a, s: F.when(s["first"] <= a["end"], F.struct(
            a["done"].alias("done"), a["first"].alias("first"), F.greatest(a["end"], s["end"]).alias("end"),
        )).otherwise(F.struct(
            F.when(a["end"] >= 0, F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["end"].alias("end")))))
            .otherwise(a["done"]).alias("done"), s["first"].alias("first"), s["end"].alias("end"),
        )),
        lambda a: F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["end"].alias("end")))),
    )
    spans = kept(spans.select(F.col("key").alias(key), joined.alias("spans")), "spans")
    done_with("meeting", "found")
    return spans


@F.pandas_udf(T.BinaryType())
def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The UTF-8 bytes of each text without those in its spans."""

    def rest(text, own):
        data = (text or "").encode("utf-8", "surrogatepass")
        if own is None or not len(own):
            return data
        out, at = [], 0
        for s in own:
            out.append(data[at:s["first"]])
            at = s["end"]
        return b"".join([*out, data[at:]])

    return pd.Series([rest(t, s) for t, s in zip(texts, spans)])


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with spans (removed byte ranges, sorted and apart) and kept_bytes; columns of these names are replaced.

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else in the table, in the same text
    or another; matches never cross texts. Repeated rows therefore remove each other, null texts are empty, texts
    shorter than ``length`` keep all, and an empty table stays empty. Texts without repeats are not shuffled.
    """
    names = [c for c in docs.columns if c not in ("spans", "kept_bytes")]
    keyed = docs.select(*names).withColumn("__key", F.xxhash64(F.col(text)))
    spans = repeated_spans(keyed, "__key", text, length)
    field = docs.sparkSession.sparkContext.broadcast(marked(spans, "__key", spans.count()))  # 32 MB at most

    @F.pandas_udf("boolean")
    def may_repeat(keys: pd.Series) -> pd.Series:
        return pd.Series(may_hold(field.value, keys.to_numpy()))

    flagged = keyed.withColumn("__may", may_repeat("__key"))
    clean = flagged.filter(~F.col("__may")).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    found = flagged.filter("__may").join(spans, "__key", "left")
    out = [frame.select(*names, "spans") for frame in (clean, found)]
    empty = F.array().cast(spans.schema["spans"].dataType)
    return out[0].union(out[1]).withColumn("kept_bytes", cut_out(F.col(text), "spans")).withColumn(
        "spans", F.coalesce("spans", empty))


@F.pandas_udf(T.StringType())
def whole_characters(data: pd.Series) -> pd.Series:
    """Text of bytes that may begin or end inside a character; such remains are left out."""
    return data.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")


def repeats_cut(docs: DataFrame, length: int, text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with the same columns, their texts without the repeated passages; ``size``, where it is a column, follows.

    Every occurrence of a passage goes, none is kept as the first. Texts without one stay as they are, null ones too.
    """
    rest = without_repeats(docs.select(F.struct("*").alias("doc"), F.col(text).alias("text")), length=length)
    rest = rest.select("doc", F.when(F.size("spans") > 0, whole_characters("kept_bytes")).otherwise(F.col("text")).alias("text"))
    columns = [
        F.col("text").alias(c) if c == text else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == size
        else F.col("doc").getField(c).alias(c)
        for c in docs.columns
    ]
    return rest.select(*columns)
