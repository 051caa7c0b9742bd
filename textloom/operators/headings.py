"""Headings of competing pages (family E): rows ``(topic_id, src, page_id, pos, heading)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SPECIAL = r"[{}<>|\\@#$^*=~]|https?://|www\."


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def clean_headings(headings: DataFrame, stop: list[str], garbage: list[str]) -> DataFrame:
    """Usable headings; of those equal but for case and punctuation, the first of the topic stays.

    Repeats are found by an aggregation that combines before the shuffle, so a heading that every page
    repeats is no large group.
    """
    low, words = F.lower("heading"), words_of(F.lower("heading"))
    bad = F.col("heading").rlike(SPECIAL) | F.col("heading").rlike(r"^[\d\s]+$")
    for g in garbage:
        bad = bad | low.contains(g)
    meaning = F.filter(words, lambda w: ~w.isin(stop))
    fits = F.length("heading").between(8, 120) & F.size(words).between(2, 15) & (F.size(meaning) > 0)
    rows = headings.filter(fits & ~bad).withColumn("norm", F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")))
    first = rows.groupBy("topic_id", "norm").agg(F.min(F.struct("page_id", "pos", "src", "heading")).alias("f"))
    return first.select("topic_id", "f.src", "f.page_id", "f.pos", "f.heading")


def heading_support(headings: DataFrame, limit: int = 40) -> DataFrame:
    """``(topic_id, heading, sources, rank)``: headings that two sources share, or three where a topic has over five."""
    each = headings.select("topic_id", "src", F.lower("heading").alias("heading")).distinct()
    total = headings.groupBy("topic_id").agg(F.countDistinct("src").alias("n_sources"))
    rows = each.groupBy("topic_id", "heading").agg(F.count(F.lit(1)).alias("sources")).join(total, "topic_id")
    rows = rows.filter(F.col("sources") >= F.when(F.col("n_sources") <= 5, 2).otherwise(3)).drop("n_sources")
    order = Window.partitionBy("topic_id").orderBy(F.desc("sources"), "heading")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def topical_coverage(headings: DataFrame, limit: int = 15) -> DataFrame:
    """``(topic_id, pattern, sources, ratio, class, sample, rank)``: headings grouped by their first three longer words."""
    found = F.slice(F.regexp_extract_all(F.lower("heading"), F.lit(r"(\p{L}{3,})"), F.lit(1)), 1, 3)
    rows = headings.filter(F.length("heading") >= 5).withColumn("pattern", F.array_join(found, " ")).filter("pattern <> ''")
    total = headings.groupBy("topic_id").agg(F.countDistinct("src").alias("n_sources"))
    rows = rows.groupBy("topic_id", "pattern").agg(F.countDistinct("src").alias("sources"), F.min("heading").alias("sample")).join(total, "topic_id")
    ratio = F.col("sources") / F.col("n_sources")
    rows = rows.withColumn("class", F.when(ratio >= 0.7, "MUST").when(ratio >= 0.5, "HIGH").when(ratio >= 0.3, "MEDIUM").otherwise("LOW")).withColumn("ratio", F.round(ratio, 6)).drop("n_sources")
    order = Window.partitionBy("topic_id").orderBy(F.desc("sources"), "pattern")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def plan_size(median: Column, strong: Column, entities: Column, length: Column) -> Column:
    """Sections of a plan: the middle of three estimates, at least four, at most eight and one per 250 words."""
    guesses = F.array(median.cast("long"), F.greatest(F.lit(4), strong).cast("long"), F.greatest(F.lit(4), F.ceil(entities / 3)).cast("long"))
    return F.greatest(F.lit(4), F.least(F.element_at(F.array_sort(guesses), 2), F.lit(8), F.floor(length / 250))).cast("long")
