"""The corpus pipeline: each stage applies one operator to all rows that the stage before it kept.

Every stage takes null ids, sources and texts, empty and very long texts, repeated rows, rows of one id with
unlike texts, empty tables and further columns, and all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, mixing, simhash, tokens, toxicity
from textloom.llm.common import remove_folder, shared_folder, table
from textloom.llm.queries import word_vocabulary

#: A trained tagger, shingle sets and a tokenizer: SQL cannot express the result.
ORACLE_SQL = None


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger rejects go, each row by its own text; null and empty texts stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, else one without an id.

    Null, empty and wordless texts are one group. Rows that repeat id and text stay once; rows of one id, or
    without an id, with unlike texts are told apart.
    """
    return simhash.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers or names, go; of rows of one id only those whose text does."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order; wordless ones not at all, a null source is one of its own."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document its place, length and checksum read back from them; null ids come first."""
    return tokens.encode_documents(docs, word_vocabulary(), memory=200_000)


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixing", source_mix),
    ("tokens", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written, read again as the next stage's input, and then removed.

    The token files stay: they are what the pipeline makes.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        if k < len(STAGES) - 1:
            docs = written(docs, path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs


def written(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` as Parquet in ``path``."""
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)
