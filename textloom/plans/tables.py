"""The given tables as the operators read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.lists import ENTITIES
from textloom.operators import entities, grams, terms, text
from textloom.operators.lineage import shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The keyword of each topic, as the operators get it from a caller.
KEYWORDS = [("en", "the"), ("fr", "la"), ("de", "die"), ("es", "mit license")]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the splits of their scan; only a scan of fewer splits than cores, one small file, is dealt anew."""
    rows, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def articles(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """``(doc_id, more, text)``: documents as markdown, which the tables lack.

    The first line is the title, lines of up to three words are headings, those of up to six list items, and every third other line ends a paragraph.
    """
    n = lambda x: F.size(F.split(x, " "))
    shaped = lambda x, i: F.when(i == 0, F.concat(F.lit("# "), x)).when(n(x) <= 3, F.concat(F.lit("## "), x)).when(n(x) <= 6, F.concat(F.lit("- "), x)).when(i % 3 == 2, F.concat(x, F.lit("\n"))).otherwise(x)
    return docs(spark, sf_dir).select("doc_id", *more, F.array_join(F.transform(F.split("text", "\n"), shaped), "\n").alias("text"))


#: The same as a DuckDB expression on ``text``.
ARTICLE_SQL = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i = 1 THEN '# ' || x WHEN len(string_split(x, ' ')) <= 3 THEN '## ' || x WHEN len(string_split(x, ' ')) <= 6 THEN '- ' || x WHEN (i - 1) % 3 = 2 THEN x || chr(10) ELSE x END), chr(10))"


def rows_of(spark: SparkSession, rows: list[tuple[str, ...]], *names: str) -> DataFrame:
    """A short list of texts as rows that the optimizer knows the size of; no Python worker makes them."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({', '.join(names)})")


def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(topic_id, n_sources, keyword)``."""
    sources = text.documents_as_sources(table(spark, sf_dir, "documents"))
    keywords = rows_of(spark, KEYWORDS, "topic_id", "keyword")
    return sources.groupBy("topic_id").agg(F.countDistinct("src_idx").alias("n_sources")).join(keywords, "topic_id")


def sized_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Documents and the characters of all."""
    rows = docs(spark, sf_dir)
    return rows, rows.agg(F.sum(F.length("text")).cast("long")).first()[0] or 0


def gram_stats(spark: SparkSession, sf_dir: str, single: bool = True) -> tuple[DataFrame, DataFrame]:
    """Statistics of the grams of the documents and, under the source null, of the signals of the topic ``en``, the benchmark's texts; and the most uses of each topic."""
    rows, chars = sized_docs(spark, sf_dir)
    signals = table(spark, sf_dir, "benchmark").select(F.lit("en").alias("topic_id"), F.col("item_id").alias("pos"), "text")
    joined = terms.signal_sources(signals).select("topic_id", F.lit(None).cast("string").alias("src_idx"), F.lit(None).cast("long").alias("doc_id"), "content")
    return grams.text_gram_stats(grams.tokens(text.documents_as_sources(rows).unionByName(joined)), chars, single)


#: What is kept of so many topics, a row or some dozens each, is broadcast; of more it is shuffled.
MANY_TOPICS = 2_000


def few_topics(topics: DataFrame) -> bool:
    return topics.select("topic_id").limit(MANY_TOPICS + 1).count() <= MANY_TOPICS


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, (stats, tops) = topics(spark, sf_dir), gram_stats(spark, sf_dir, False)
    return grams.weight_grams(stats, known, few_topics(known), tops)


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """h1 headings of the pages: topic = language in the path, source = domain."""
    pages = table(spark, sf_dir, "pages")
    rows = text.html_headings(pages.withColumn("src", text.domain_of(F.col("url"))), level=1, keys=("page_id", "url", "src"))
    topic = F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})(?:/|$)", 1)
    return long(rows.select(topic.alias("topic_id"), "src", "page_id", "pos", "heading"), "pos")


def mentions(spark: SparkSession, sf_dir: str, around: int = 0, placed: bool = True) -> DataFrame:
    gazetteer = rows_of(spark, ENTITIES, "phrase", "etype")
    return entities.match_entities(text.documents_as_sources(docs(spark, sf_dir)), gazetteer, around, placed=placed)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the first entities of each topic."""
    found, n_sources = mentions(spark, sf_dir, 50), topics(spark, sf_dir).drop("keyword")
    return entities.cooccurrence(found, entities.entity_stats(mentions(spark, sf_dir, placed=False), n_sources), n_sources)
