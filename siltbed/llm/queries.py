"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import html_extraction, merkle_sql, toxicity
from siltbed.llm.bpe_codec import encoding_digests
from siltbed.llm.byte_bpe import byte_token_counts
from siltbed.llm.embedding_dedup import near_duplicates
from siltbed.llm.embedding_whitening import whitened
from siltbed.llm.jaccard_join import jaccard_components
from siltbed.llm.lexical_packing import lexically_packed
from siltbed.llm.merkle_manifest import leaf_hash, manifest
from siltbed.llm.packing import packed
from siltbed.llm.quality_rules import judged
from siltbed.llm.sharding import sharded
from siltbed.llm.suffix_dedup import without_repeats
from siltbed.llm.token_counts import with_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op6_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_token_counts(docs, VOCABULARY).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


@query("op9_bpe_codec")
def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encoding_digests(docs, VOCABULARY).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op8_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))


@query("op3_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@query("op4_embedding_dedup")
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), byte_token_counts(F.col("text")))


@query("op2_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), width=4, percent=85)


@query("op10_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) - F.octet_length("kept_bytes")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


@query("op7_html_extraction")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    labeller = html_extraction.train(pages)
    return html_extraction.with_main_text(pages, labeller).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


@query("op11_merkle_manifest")
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    altered = F.when(tampered, leaf_hash([lowered if f == "text" else F.col(f) for f in MANIFEST_FIELDS]))
    return manifest(documents(spark, sf_dir), MANIFEST_FIELDS, altered=altered).select(
        F.col("place").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


ORACLES["op11_merkle_manifest"] = merkle_sql.oracle()


@query("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op13_lexical_packing")
def lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexically_packed(documents(spark, sf_dir))
