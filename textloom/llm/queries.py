"""The operators as registered queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table
from textloom.llm.cotraining import classify_quality
from textloom.llm.decontaminate import contaminated
from textloom.llm.embeddings import vector_components
from textloom.llm.licenses import scan_licenses
from textloom.llm.linkgraph import filter_urls
from textloom.llm.mixing import curriculum
from textloom.llm.repair import repair_conversations
from textloom.llm.secrets import scan_secrets
from textloom.llm.sharding import shard_documents
from textloom.llm.simhash import simhash_components
from textloom.llm.spelling import spelling_groups
from textloom.llm.tokens import encode_documents
from textloom.llm.toxicity import toxicity


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), word_vocabulary())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "matched", "coverage")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = curriculum(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    written = F.array_join(F.transform("positions", lambda p: F.round(p, 9).cast("decimal(12,9)").cast("string")), ",")
    rows = mix.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")
    return rows.select("doc_id", "size", "source_size", "target", "taken", written.alias("positions"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_urls": op2_urls,
        "op3_sharding": op3_sharding,
        "op4_tokens": op4_tokens,
        "op5_simhash": op5_simhash,
        "op6_decontamination": op6_decontamination,
        "op7_licenses": op7_licenses,
        "op8_toxicity": op8_toxicity,
        "op9_embedding_neardup": op9_embedding_neardup,
        "op10_mixing": op10_mixing,
        "op11_spelling": op11_spelling,
        "op12_repair": op12_repair,
        "op13_secrets": op13_secrets,
    }
