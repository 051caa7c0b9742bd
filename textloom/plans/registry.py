"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.lists import BANNED, BUDGETS, CSS, FACTS, LEXICON, PART_ENTITIES, PHRASES, SCRIPTS, SHOP, STOP, STYLE_STOP, WEIGHTED
from textloom.operators.terms import quality_reason
from textloom.operators import checks, entities, facts, grams, headings, text, vectors
from textloom.plans import articles, editing, gaps, lists, salience, sections, stored, terms
from textloom.plans.tables import docs as _docs, headings as _headings, long as _long, mentions as _mentions, pairs as _pairs, articles as _articles, few_topics, gram_stats as _gram_stats, sized_docs, table as _table, topics as _topics, weighted as _weighted
from textloom.plans.twins import NAV_LINES, TWINS
from textloom.streaming import budgets


def a3_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.filter_urls(_table(spark, sf_dir, "pages"), ["utm_source", "blog."]).select("page_id", "url")


def a4_admit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(text.admit_sources(text.documents_as_sources(_docs(spark, sf_dir))).select("topic_id", "src_idx", "doc_id", "chars", "word_count"), "chars", "word_count")


def a6_with_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.domain_of(F.col("url")).alias("domain"))


def a10_strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.strip_markup(F.col("text"))).alias("digest"))


def b1_html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(text.html_headings(_table(spark, sf_dir, "pages"), level=1), "pos")


def b2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.html_main_text(F.col("html")).alias("content"))


def b4_strip_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_artifacts(F.col("html"))).alias("digest"))


def b5_line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.line_features(text.lines_of(_docs(spark, sf_dir)), STOP)
    return _long(rows.select("doc_id", "pos", "chars", "n_words", F.round("density", 6).alias("density"), F.round("capital", 6).alias("capital"), "boilerplate"), "pos", "chars", "n_words")


def b7_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.clean_lines(_docs(spark, sf_dir), NAV_LINES, STOP)


def b8_finish_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.finish_text(F.col("text"))).alias("digest"))


def d1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grams.tokens(text.documents_as_sources(_docs(spark, sf_dir)))
    return _long(rows.select("doc_id", F.size("words").alias("n_tokens"), F.md5(F.array_join("words", " ")).alias("digest")), "n_tokens")


def d4_gram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram_stats(spark, sf_dir)[0]


def d4_gram_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a lexicon that takes plurals and forms of some words together."""
    docs, chars = sized_docs(spark, sf_dir)
    toks = grams.lemma_words(grams.tokens(text.documents_as_sources(docs)), dict(LEXICON))
    return grams.text_gram_displays(toks, chars).filter("freq >= 2")


def d7_weight_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir).select("topic_id", "gram", "freq", "sources", "in_signals", "weight")


def d8_top_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = grams.top_grams(_weighted(spark, sf_dir), n=30)
    return _long(top.select("topic_id", "rank", "gram", "freq", "sources", "freq_min", "freq_median", "freq_max", "weight"), "rank")


def d8_top_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over lemmas, each gram with the way it is written most."""
    docs, chars = sized_docs(spark, sf_dir)
    toks = grams.lemma_words(grams.tokens(text.documents_as_sources(docs)), dict(LEXICON))
    topics = _topics(spark, sf_dir)
    few = few_topics(topics)
    stats, tops = grams.text_gram_stats(toks, chars, False)
    top = grams.top_grams(grams.weight_grams(stats, topics, few, tops), n=30)
    return _long(grams.with_displays(top, toks, few).select("topic_id", "rank", "gram", "display", "freq", "sources", "weight"), "rank")


def d9_extended_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = grams.listed_grams(_weighted(spark, sf_dir))
    return _long(grams.extended_terms(weighted, grams.top_grams(weighted)).select("topic_id", "rank", "gram", "sources", "weight"), "rank")


def d13_repeated_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.repeated_trigrams(_docs(spark, sf_dir), STOP)


def j2_phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.phrase_hits(_docs(spark, sf_dir), PHRASES)


def j3_opener_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.opener_hits(_docs(spark, sf_dir), ["the ", "de ", "le "])


def j4_char_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.char_hits(_docs(spark, sf_dir), "%$#|")


def j5_entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.entity_coverage(_docs(spark, sf_dir), ["license", "the", "idiot"])


def j7_uniform_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.uniform_paragraphs(_docs(spark, sf_dir))


def j8_list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.list_groups(_articles(spark, sf_dir))


def j15_style_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.style_score(_articles(spark, sf_dir), PHRASES, ["the ", "de "], BANNED, "%$#|", STYLE_STOP)


def h6_keyword_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.keyword_cosine(_table(spark, sf_dir, "embeddings"))


def h6_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.similar_pairs(_table(spark, sf_dir, "embeddings"), 0.3)
    return rows.withColumn("sim", F.round("sim", 6))


def b6_flag_nav_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.flag_nav_lines(text.line_features(text.lines_of(_docs(spark, sf_dir)), STOP))
    return _long(rows.select("doc_id", "pos", "nav"), "pos")


def b9_strip_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_css(F.col("html"), CSS)).alias("digest"))


def d16_keyphrase_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grams.keyphrase_priority(_weighted(spark, sf_dir), quality_reason(F.col("gram"), STOP, terms.CSS_WORDS, SHOP, terms.NAV)).select("topic_id", "rank", "gram", "priority", "weight")
    return _long(rows, "rank", "priority")


def e1_clean_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.clean_headings(_headings(spark, sf_dir), STOP, SHOP)


def e2_heading_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(headings.heading_support(_headings(spark, sf_dir)), "rank")


def e5_topical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(headings.topical_coverage(_headings(spark, sf_dir)), "rank")


def f1_match_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_mentions(spark, sf_dir).select("topic_id", "doc_id", "pos", "start_char", "end_char", "phrase", "etype"), "pos")


def f2_entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(entities.entity_stats(_mentions(spark, sf_dir), _topics(spark, sf_dir).drop("keyword")), "rank")


def f2_entity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts as one text each, for comparison."""
    rows = entities.entity_details(_mentions(spark, sf_dir, 50))
    return _long(rows.withColumn("contexts", F.array_join("contexts", " | ")), "freq_median")


def f13_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_pairs(spark, sf_dir), "rank")


def g1_bundle_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.bundle_texts(text.documents_as_sources(_docs(spark, sf_dir)))
    return rows.select("topic_id", F.length("bundle").cast("long").alias("chars"), F.md5("bundle").alias("digest"))


def h10_target_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.target_length(_docs(spark, sf_dir))


def h11_hard_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(facts.hard_facts(_docs(spark, sf_dir), FACTS), "rank")


def h14_dedup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.dedup_records(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


def j1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(checks.sentences(_docs(spark, sf_dir)).select("doc_id", "pos", F.md5("sentence").alias("digest")), "pos")


def j9_foreign_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some letters are written in other scripts, which the given texts lack."""
    return checks.foreign_scripts(_docs(spark, sf_dir).withColumn("text", F.translate("text", "zjqx", "жй中م")), SCRIPTS)


def j17_gram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.gram_coverage(_docs(spark, sf_dir), WEIGHTED)


def j17_gram_coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.gram_coverage(_docs(spark, sf_dir), WEIGHTED, strict=False)


def l3_budgets_from_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grams.top_grams(_weighted(spark, sf_dir))
    return rows.select("topic_id", "gram", F.col("freq_min").alias("low"), F.greatest("freq_max", F.lit(1)).alias("high"))


def k1_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets.budget_batches(_table(spark, sf_dir, "conversations"), BUDGETS, "conv_id", "turn")


def k2_check_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets.check_parts(_table(spark, sf_dir, "conversations"), PHRASES, "%$#|", ["conv_id", "turn"], PART_ENTITIES, "is")


QUERIES = [a3_filter_urls, a4_admit_sources, a6_with_domain, a10_strip_markup, b1_html_headings, b2_html_main_text, b4_strip_artifacts, b5_line_features, b7_clean_lines, b8_finish_text, d1_tokens, d4_gram_stats, d4_gram_displays, d7_weight_grams, d8_top_grams, d8_top_displays, d9_extended_terms, d13_repeated_trigrams, h6_keyword_cosine, h6_similar_pairs, j2_phrase_hits, j3_opener_hits, j4_char_hits, j5_entity_coverage, j7_uniform_paragraphs, j8_list_groups, j15_style_score]
QUERIES += [b6_flag_nav_lines, b9_strip_css, d16_keyphrase_priority, e1_clean_headings, e2_heading_support, e5_topical_coverage, f1_match_entities, f2_entity_stats, f2_entity_details, f13_cooccurrence, g1_bundle_texts, h10_target_length, h11_hard_facts, h14_dedup_records, j1_sentences, j9_foreign_scripts, j17_gram_coverage, j17_gram_coverage_audit, l3_budgets_from_grams, k1_budget_batches, k2_check_parts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES + articles.QUERIES + terms.QUERIES + gaps.QUERIES + stored.QUERIES + salience.QUERIES + sections.QUERIES + editing.QUERIES + lists.QUERIES}


def oracle_sql() -> dict[str, str]:
    return TWINS | articles.TWINS | terms.TWINS | gaps.TWINS | stored.TWINS | salience.TWINS | sections.TWINS | editing.TWINS | lists.TWINS
