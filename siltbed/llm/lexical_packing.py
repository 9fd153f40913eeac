"""Packing by lexical retrieval: a window is filled by the unused neighbours that BM25 finds for its seed document.

Whole windows of a long document are sequences of their own; what is left of each document, less than a window, is
packed. Term frequencies are counted over all whole texts. Rests are range-partitioned by their two heaviest terms, so
lexical neighbours stand next to each other, and each sorted partition is cut into index shards of a bounded number of
rests, however many share a term or a text. In a shard, an inverted index (postings with BM25 weights by term) scores all unused
rests for a seed at once; in falling order they fill the seed's window, the last one is cut there, and its remainder is the next
seed. A shard's unfinished window goes on in the next shard; the last one of a partition is cut at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.batches import BATCH_BYTES
from siltbed.llm.byte_bpe import RANKS, VOCABULARY_SIZE, byte_encoder
from siltbed.session import scratch_path

WINDOW = 1024
END = 0
SHARD_RESTS = 1024
PARTITION_TOKENS = 32 << 20
SATURATION, LENGTH_PART = 1.2, 0.75  # k1 and b of BM25
TASK_SHIFT = 33  # identifiers: the task above, its sequences below
REST_TYPE = np.dtype("<u2")  # identifiers are below 2^16
PIECE_FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@dataclass(frozen=True)
class Statistics:
    """Weight of each term over the corpus and the mean length of rests; bounded by the vocabulary."""

    idf: np.ndarray
    shared: np.ndarray  # terms of at least two documents
    mean: float

    def weights(self, terms: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        norm = SATURATION * (1 - LENGTH_PART + LENGTH_PART * lengths / self.mean)
        return self.idf[terms] * times * (SATURATION + 1) / (times + norm)

    def heaviest(self, ids: np.ndarray) -> tuple[int, int]:
        """The two heaviest terms that other documents hold too; -1 where there is none."""
        terms, times = np.unique(ids, return_counts=True)
        some = self.shared[terms] & (self.idf[terms] > 0)
        terms, times = terms[some], times[some]
        order = np.argsort(-self.weights(terms, times, np.float64(len(ids))), kind="stable")[:2]
        return (*terms[order].tolist(), -1, -1)[:2]


def statistics(frequencies: Iterable[tuple[int, int]], documents: int, mean: float) -> Statistics:
    df = np.zeros(VOCABULARY_SIZE)
    for term, n in frequencies:
        df[term] = n
    idf = np.log((documents - df + 0.5) / (df + 0.5))
    return Statistics(np.maximum(idf, 0.0), df >= 2, max(mean, 1.0))  # terms of most documents tell nothing


@dataclass
class Rest:
    """What is still to be packed of a document."""

    doc: object
    start: int
    doc_tokens: int
    ids: np.ndarray


class Index:
    """Postings of a shard's rests by term, with BM25 weights."""

    def __init__(self, rests: list[Rest], corpus: Statistics):
        n = len(rests)
        lengths = np.array([len(r.ids) for r in rests])
        terms = np.concatenate([r.ids for r in rests]).astype(np.int64)
        owners = np.repeat(np.arange(n), lengths)
        telling = corpus.idf[terms] > 0
        pairs, times = np.unique(terms[telling] * n + owners[telling], return_counts=True)
        terms, self.owners = pairs // n, pairs % n
        self.weights = corpus.weights(terms, times, lengths[self.owners].astype(np.float64))
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        self.starts, self.counts = first, np.diff(np.append(first, len(terms)))
        by_owner = np.argsort(self.owners, kind="stable")
        self.terms = np.repeat(np.arange(len(first)), self.counts)[by_owner]
        self.bounds = np.searchsorted(self.owners[by_owner], np.arange(n + 1))
        self.size = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every rest for the terms of the seed."""
        own = self.terms[self.bounds[seed]:self.bounds[seed + 1]]
        counts = self.counts[own]
        before = np.cumsum(counts) - counts
        at = np.repeat(self.starts[own] - before, counts) + np.arange(counts.sum())
        return np.bincount(self.owners[at], weights=self.weights[at], minlength=self.size)


class Packer:
    """Sequences of one task, shard after shard; pieces wait as (rest, start, length, crc, sequence, offset, score)."""

    def __init__(self, corpus: Statistics, task: int, window: int):
        self.corpus, self.task, self.window = corpus, task, window
        self.sequences, self.pieces = 0, []

    def close(self, chosen: list[tuple[Rest, int, float | None]]) -> None:
        """One sequence of the first so many ids of each chosen rest."""
        identifier, offset = ((self.task << TASK_SHIFT) + self.sequences) * 2 + 1, 0
        for rest, many, score in chosen:
            self.pieces.append((
                rest.doc, rest.start, many, checksum(rest.ids[:many]), rest.doc_tokens, identifier, offset, score
            ))
            rest.start, rest.ids, offset = rest.start + many, rest.ids[many:], offset + many
        self.sequences += 1

    def pack(self, rests: list[Rest]) -> list[Rest]:
        """Fill windows with the rests of a shard; returns those that are left, less than a window together."""
        index = Index(rests, self.corpus)
        left = np.array([len(r.ids) for r in rests])
        total, following, cut = int(left.sum()), 0, None
        while total >= self.window:
            if cut is None:
                while not left[following]:
                    following += 1
            seed = following if cut is None else cut
            scores = index.scores(seed)
            scores[seed] = np.inf
            order = np.argsort(np.where(left > 0, -scores, np.inf), kind="stable")
            reach = np.cumsum(left[order])
            last = int(np.searchsorted(reach, self.window))
            chosen = order[:last + 1]
            take = left[chosen]
            take[-1] -= reach[last] - self.window
            self.close([
                (rests[i], many, None if i == seed else float(scores[i])) for i, many in zip(chosen.tolist(), take.tolist())
            ])
            left[chosen] -= take
            cut = int(chosen[-1]) if left[chosen[-1]] else None
            total -= self.window
        return [r for r in rests if len(r.ids)]

    def finish(self, rests: list[Rest]) -> None:
        """The last tokens of a task, less than a window, in sequences whose lengths are powers of two."""
        total = sum(len(r.ids) for r in rests)
        at = 0
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            chosen = []
            while room:
                many = min(room, len(rests[at].ids))
                chosen.append((rests[at], many, None))
                room -= many
                at += many == len(rests[at].ids)
            self.close(chosen)

    def drained(self, doc_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.pieces)) or [[]] * (2 + len(PIECE_FIELDS))
        self.pieces = []
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], doc_type), *[pa.array(c, pa.int64()) for c in columns[1:-1]], pa.array(columns[-1], pa.float64())],
            ["doc_id", *PIECE_FIELDS, "score"],
        )


def encoded(docs: DataFrame, ranks: str, window: int) -> DataFrame:
    """One row per document (doc_id, doc_tokens, crcs of whole windows, their first identifier, rest), and one per task
    with the number of documents of each term."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, sequences = byte_encoder(ranks), TaskContext.get().partitionId(), 0
        frequencies = np.zeros(VOCABULARY_SIZE, np.int64)
        for batch in batches:
            sizes, crcs, firsts, rests = [], [], [], []
            for text in batch.column("text"):
                ids = ids_of(text.as_py() or "")
                frequencies[np.unique(ids)] += 1
                ids = np.append(ids, np.uint32(END))
                whole = len(ids) // window
                sizes.append(len(ids))
                crcs.append([checksum(ids[i * window:(i + 1) * window]) for i in range(whole)])
                firsts.append(((task << TASK_SHIFT) + sequences) * 2)
                rests.append(ids[whole * window:].astype(REST_TYPE).tobytes())
                sequences += whole
            empty = pa.nulls(len(sizes), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                pa.array(firsts, pa.int64()), pa.array(rests, pa.binary()), empty, empty,
            ], names)
        terms = np.flatnonzero(frequencies)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(1, arrow_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.int64()),
            pa.nulls(1, pa.binary()), pa.array([terms.tolist()], pa.list_(pa.int64())),
            pa.array([frequencies[terms].tolist()], pa.list_(pa.int64())),
        ], names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["doc_id", "doc_tokens", "crcs", "sequence_id", "rest", "terms", "counts"]
    arrow_type = to_arrow_type(docs.schema["doc_id"].dataType)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("doc_tokens", "long").add("crcs", longs)
    schema = schema.add("sequence_id", "long").add("rest", "binary").add("terms", longs).add("counts", longs)
    return docs.mapInArrow(encode, schema)


def with_heaviest_terms(rests: DataFrame, corpus: Statistics) -> DataFrame:
    """Rests with columns first and second, the terms that place them."""
    idf, shared, mean = corpus.idf, corpus.shared, corpus.mean

    @F.pandas_udf("struct<first:int,second:int>")
    def placed(column):
        import pandas as pd

        corpus = Statistics(idf, shared, mean)
        return pd.DataFrame(
            [corpus.heaviest(np.frombuffer(ids, REST_TYPE)) for ids in column], columns=["first", "second"], dtype="int32"
        )

    return rests.withColumn("near", placed("rest")).select(*rests.columns, "near.first", "near.second")


def lexically_packed(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", ranks: str = RANKS, window: int = WINDOW
) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, score.

    A document is its ids and id 0 at the end; each id lies in exactly one piece. ``score`` is the BM25 score with which the
    piece's document was retrieved for the seed of its sequence; null for seeds, for whole windows of one document and for the last
    sequences of a task. Every sequence is a full window or, for the last ones of a task, as long as a power of two, so nothing
    is padded. A null or empty text is the one id 0; repeated rows and null ids are packed each; an empty table
    gives no rows; other columns are not read. Identifiers of sequences are unique, not gapless.

    Texts are read and encoded once; only rests move, two bytes for each id. What is broadcast or collected is one number
    for each term of the vocabulary.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "lexical")
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(BATCH_BYTES))
    try:
        named = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
        encoded(named, ranks, window).write.parquet(f"{path}/encoded")
        pieces = spark.read.parquet(f"{path}/encoded")
        _packed_rests(pieces, window).write.parquet(f"{path}/packed")
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    whole = pieces.select("doc_id", "doc_tokens", "sequence_id", F.posexplode("crcs").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
        "doc_tokens", (F.col("sequence_id") + F.col("i") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(None).cast("double").alias("score"),
    )
    return spark.read.parquet(f"{path}/packed").unionByName(whole)


def _packed_rests(pieces: DataFrame, window: int) -> DataFrame:
    spark = pieces.sparkSession
    width = REST_TYPE.itemsize
    documents = pieces.filter("doc_tokens IS NOT NULL")
    frequencies = pieces.filter("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy(
        F.col("e.terms").alias("term")
    ).agg(F.sum("e.counts").alias("n")).collect()  # at most one row for each term of the vocabulary
    rests = documents.filter(F.octet_length("rest") > 0).select(
        "doc_id", (F.col("doc_tokens") - F.octet_length("rest") / width).cast("long").alias("start"), "doc_tokens", "rest"
    )
    n_documents = documents.count()
    n, tokens = rests.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("rest")), F.lit(0)) / width).first()
    corpus = statistics(((r.term, r.n) for r in frequencies), n_documents, tokens / max(1, n))
    shared = spark.sparkContext.broadcast((corpus.idf, corpus.shared, corpus.mean))  # bounded by the vocabulary

    # As many partitions as cores, if each then has some shards; more where a partition would be too large.
    partitions = int(max(1, min(spark.sparkContext.defaultParallelism, n // (4 * SHARD_RESTS)), tokens // PARTITION_TOKENS))
    keys = ["first", "second", "salt"]
    placed = (
        with_heaviest_terms(rests, corpus)
        .withColumn("salt", F.xxhash64("doc_id"))
        .repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys, "rest")
        .select("doc_id", "start", "doc_tokens", "rest")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(Statistics(*shared.value), TaskContext.get().partitionId(), window)
        waiting: list[Rest] = []
        added = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "rest")]
            for doc, start, doc_tokens, ids in zip(*columns):
                waiting.append(Rest(doc, start, doc_tokens, np.frombuffer(ids, REST_TYPE)))
                added += 1
                if added == SHARD_RESTS:
                    waiting, added = packer.pack(waiting), 0
            yield packer.drained(batch.column("doc_id").type)
        if waiting:
            packer.finish(packer.pack(waiting))
            yield packer.drained(batch.column("doc_id").type)

    schema = T.StructType().add("doc_id", pieces.schema["doc_id"].dataType)
    for name in PIECE_FIELDS:
        schema = schema.add(name, "long")
    return placed.mapInArrow(pack, schema.add("score", "double"))
