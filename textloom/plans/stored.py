"""Reading sources, keeping results by topic, and the size of a plan, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import entities, facts, headings, text
from textloom.plans import tables as t
from textloom.plans.twins import _HEADS, TWINS as _BASE
from textloom.sources import pages


def a1_read_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.read_sources(spark, f"{sf_dir}/documents.parquet")
    return rows.groupBy("topic_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


def a8_upsert_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all topics are stored in the shared folder, those of ``en`` replaced by others, and all read back."""
    path = f"{t.shared_folder(spark)}/topics-{uuid.uuid4().hex}"
    rows = a1_read_sources(spark, sf_dir).select("topic_id", "source", "n")
    pages.upsert_topics(rows, path)
    pages.upsert_topics(rows.filter("topic_id = 'en'").withColumn("n", F.col("n") * 2), path)
    return spark.read.schema("source string, n long, topic_id string").parquet(path)


def e7_plan_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, sources = t.headings(spark, sf_dir), text.documents_as_sources(t.docs(spark, sf_dir))
    n_sources = sources.groupBy("topic_id").agg(F.countDistinct("src_idx").alias("n_sources"))
    per_page = heads.groupBy("topic_id", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("topic_id").agg(F.floor(F.percentile("n", 0.5)).alias("median"))
    strong = headings.heading_support(heads).groupBy("topic_id").agg(F.count(F.lit(1)).alias("strong"))
    found = entities.entity_stats(t.mentions(spark, sf_dir), n_sources).groupBy("topic_id").agg(F.count(F.lit(1)).alias("entities"))
    length = facts.target_length(t.docs(spark, sf_dir)).select(F.col("lang").alias("topic_id"), F.col("target").alias("length"))
    rows = length.join(per_page, "topic_id", "left").join(strong, "topic_id", "left").join(found, "topic_id", "left").fillna(0)
    return rows.select("topic_id", headings.plan_size(F.col("median"), F.col("strong"), F.col("entities"), F.col("length")).alias("sections"))


QUERIES = [a1_read_sources, a8_upsert_topic, e7_plan_size]
TWINS = {
    "a1_read_sources": "SELECT lang AS topic_id, source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL",
    "a8_upsert_topic": "SELECT topic_id, source, CASE WHEN topic_id = 'en' THEN 2 * n ELSE n END AS n FROM (SELECT lang AS topic_id, source, count(*) AS n FROM documents GROUP BY ALL)",
    "e7_plan_size": f"WITH {_HEADS}, pp AS (SELECT topic_id, floor(quantile_cont(n, 0.5))::BIGINT AS med FROM (SELECT topic_id, page_id, count(*) AS n FROM heads GROUP BY ALL) GROUP BY 1), st AS (SELECT topic_id, count(*) AS strong FROM ({_BASE['e2_heading_support']}) GROUP BY 1), en AS (SELECT topic_id, count(*) AS ents FROM ({_BASE['f2_entity_stats']}) GROUP BY 1), le AS (SELECT lang AS topic_id, target FROM ({_BASE['h10_target_length']})), "
    "x AS (SELECT topic_id, target, list_sort([COALESCE(med, 0), GREATEST(4, COALESCE(strong, 0)), GREATEST(4, ceil(COALESCE(ents, 0) / 3)::BIGINT)])[2] AS mid FROM le LEFT JOIN pp USING (topic_id) LEFT JOIN st USING (topic_id) LEFT JOIN en USING (topic_id)) SELECT topic_id, GREATEST(4, LEAST(mid, LEAST(8, target // 250))) AS sections FROM x",
}
