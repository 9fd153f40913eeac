"""A corpus cleaned in stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of ``docs``; the last
one returns where each piece of the remaining texts is packed. Null and empty texts, ties, repeated rows, empty tables
and extra columns have the results that the operators state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import quality_rules, toxicity
from siltbed.llm.byte_bpe import byte_token_counts
from siltbed.llm.jaccard_join import one_of_each_group
from siltbed.llm.packing import packed
from siltbed.llm.suffix_dedup import repeats_cut
from siltbed.session import scratch_path

NEAR_WORDS, NEAR_PERCENT = 5, 80
#: A passage of some fifty words.
REPEATED_BYTES = 240


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar doesn't call toxic."""
    model = toxicity.train(docs, labels(spark, sf_dir))
    body = docs.select(F.struct("*").alias("doc"), "text")
    return toxicity.scored(body, model).filter("predicted = 0").select("doc.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    body = docs.select(F.struct("*").alias("doc"), "doc_id", "text", "lang")
    return quality_rules.judged(body, labels(spark, sf_dir), ["doc"]).filter("kept").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return one_of_each_group(docs, NEAR_WORDS, NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand elsewhere, each occurrence of them; what is left of a text stays, be it
    empty."""
    return repeats_cut(docs, REPEATED_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is packed."""
    return packed(docs, byte_token_counts(F.col("text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Trained scores, components and byte windows have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return docs
