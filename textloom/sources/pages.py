"""Sources that a caller supplies, and results kept by topic (A1, A8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string"


def read_sources(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = SCHEMA) -> DataFrame:
    """``(topic_id, source, doc_id, content)`` from files of ``fmt``; the schema is stated, so nothing is inferred and no other column read."""
    rows = spark.read.format(fmt).schema(schema).load(path)
    return rows.select(F.col("lang").alias("topic_id"), "source", "doc_id", F.col("text").alias("content"))


def upsert_topics(rows: DataFrame, path: str, key: str = "topic_id") -> None:
    """Write ``rows`` by topic; a topic among them replaces its former rows, the others stay as they are."""
    rows.write.partitionBy(key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "topic_id"):
    """The same for a stream: each micro-batch replaces the topics that it holds; returns the started query."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert_topics(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
