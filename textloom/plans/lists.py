"""Whole sets of lists as a consumer gets them: moderated, placed and trimmed, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import grams, headings
from textloom.operators import terms as operators
from textloom.operators.gaps import normalise_facts
from textloom.operators.lineage import materialise
from textloom.plans import gaps, salience, terms
from textloom.plans import tables as t
from textloom.plans.twins import _WEIGHT, TWINS as _BASE

#: Entities that the moderation list names.
FLAGGED_ENTITIES = ["Idiot", "nobody"]


def _moderation(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Ranked grams, entities and triplets by index; flagged are what the benchmark holds, some names, and triplets on ``the``."""
    index = (F.col("doc_id") * 10_000 + F.col("pos")).alias("index")
    triplets = normalise_facts(gaps._facts(spark, sf_dir)).select("topic_id", index, F.concat_ws(" ", "subject", "predicate", "object").alias("item"), "subject")
    lists = {
        "gram": terms._top(spark, sf_dir).select("topic_id", F.col("gram").alias("item")),
        "entity": terms._entities(spark, sf_dir).select("topic_id", F.col("phrase").alias("item")),
        "triplet": triplets.drop("subject"),
    }
    listed = terms._benchmark_pairs(spark, sf_dir).select(F.lit("gram").alias("kind"), F.col("term").alias("flag"))
    named = spark.createDataFrame([("entity", e) for e in FLAGGED_ENTITIES], "kind string, flag string")
    numbers = triplets.filter("subject = 'The'").select(F.lit("triplet").alias("kind"), F.col("index").cast("string").alias("flag"))
    return lists, listed.unionByName(named).unionByName(numbers)


def moderated_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """The kept rows of all lists, written in one pass, and how many each list had before and has after it."""
    lists, flagged = _moderation(spark, sf_dir)
    kept, counts = operators.moderated(lists, flagged, {"gram": "item", "entity": "item", "triplet": "index"})
    tall = [rows.select(F.lit(kind).alias("kind"), "topic_id", F.col("index") if "index" in rows.columns else F.lit(-1).cast("long").alias("index"), "item") for kind, rows in kept.items()]
    written = materialise(reduce(DataFrame.unionByName, tall))
    return written, {kind: (operators.observed_count(before), operators.observed_count(after)) for kind, (before, after) in counts.items()}


def d12_moderated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the counts of its list in each row."""
    rows, counts = moderated_lists(spark, sf_dir)
    number = lambda k: F.coalesce(*[F.when(F.col("kind") == kind, F.lit(c[k]).cast("long")) for kind, c in counts.items()])
    return rows.withColumns({"n_before": number(0), "n_after": number(1)})


def _consumed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    weighted = grams.listed_grams(t.weighted(spark, sf_dir))
    top = grams.top_grams(weighted)
    return {
        "grams": top,
        "extended": grams.extended_terms(weighted, top),
        "headings": headings.heading_support(t.headings(spark, sf_dir)),
        "entities": terms._entities(spark, sf_dir),
        "pairs": t.pairs(spark, sf_dir).withColumn("pair", F.concat_ws(" + ", "a", "b")),
        "gaps": gaps.h4_merge_gaps(spark, sf_dir),
    }


#: The columns of each list that a consumer reads: the item and what is said of it.
COLUMNS = {"grams": ["gram", "range"], "extended": ["gram", "weight"], "headings": ["heading", "sources"], "entities": ["phrase", "importance"], "pairs": ["pair", "strength"], "gaps": ["heading", "priority"]}


def a9_trim_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists in one table; what is said of an item is a number or a text."""
    trimmed = operators.trim_lists(_consumed(spark, sf_dir), COLUMNS)

    def tall(name: str, rows: DataFrame) -> DataFrame:
        item, said = COLUMNS[name]
        number = dict(rows.dtypes)[said] != "string"
        text, value = (F.lit(None).cast("string"), F.col(said).cast("double")) if number else (F.col(said), F.lit(None).cast("double"))
        return rows.select(F.lit(name).alias("list"), "topic_id", F.col("rank").cast("long").alias("rank"), F.col(item).alias("item"), text.alias("said"), value.alias("value"))

    return reduce(DataFrame.unionByName, [tall(name, rows) for name, rows in trimmed.items()])


def f14_placement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operators.placement_plan(terms._entities(spark, sf_dir), t.pairs(spark, sf_dir), salience.f9_topical_entities(spark, sf_dir), salience.f15_extract_relations(spark, sf_dir))
    return t.long(rows, "rank")


QUERIES = [d12_moderated_lists, a9_trim_lists, f14_placement_plan]


def _moderated() -> str:
    names = ", ".join(f"'{e.lower()}'" for e in FLAGGED_ENTITIES)
    return f"""WITH {terms._BENCH}, g AS (SELECT 'gram' AS kind, topic_id, -1::BIGINT AS index, gram AS item, lower(gram) IN (SELECT term FROM bp) AS flagged FROM (WITH {_WEIGHT} SELECT * FROM topped) WHERE rank <= 30),
e AS (SELECT 'entity' AS kind, topic_id, -1::BIGINT AS index, phrase AS item, phrase IN ({names}) AS flagged FROM ({_BASE['f2_entity_stats']})),
{gaps._FACTS}, f AS (SELECT 'triplet' AS kind, topic_id, doc_id * 10000 + pos AS index, subject || ' ' || predicate || ' ' || object AS item, subject = 'The' AS flagged FROM facts),
al AS (SELECT * FROM g UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f), n AS (SELECT kind, count(*) AS n_before, count(*) FILTER (NOT flagged) AS n_after FROM al GROUP BY 1)
SELECT kind, topic_id, index, item, n_before, n_after FROM al JOIN n USING (kind) WHERE NOT flagged"""


def _trimmed() -> str:
    lists = {
        "grams": (f"SELECT *, freq_min || '-' || freq_max AS range FROM (WITH {_WEIGHT} SELECT * FROM topped) WHERE rank <= 30", "gram", "range", "NULL"),
        "extended": (_BASE["d9_extended_terms"], "gram", "NULL", "weight"),
        "headings": (_BASE["e2_heading_support"], "heading", "NULL", "sources"),
        "entities": (_BASE["f2_entity_stats"], "phrase", "NULL", "importance"),
        "pairs": (_BASE["f13_cooccurrence"], "a || ' + ' || b", "NULL", "strength"),
        "gaps": (gaps.TWINS["h4_merge_gaps"], "heading", "priority", "NULL"),
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS list, topic_id, rank, {item} AS item, {said}::VARCHAR AS said, {value}::DOUBLE AS value FROM ({sql}) WHERE rank <= {operators.LIST_LIMITS[name]}" for name, (sql, item, said, value) in lists.items())


TWINS = {
    "d12_moderated_lists": _moderated(),
    "a9_trim_lists": _trimmed(),
    "f14_placement_plan": f"SELECT topic_id, role AS kind, rank, phrase AS item FROM ({terms.TWINS['f14_placement_roles']}) UNION ALL SELECT topic_id, 'pair', rank, a || ' + ' || b FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY topic_id ORDER BY strength DESC, a, b) AS rank FROM ({_BASE['f13_cooccurrence']}) WHERE strength >= 0.2) WHERE rank <= 5 "
    f"UNION ALL SELECT topic_id, 'concept', rank, display FROM ({salience.TWINS['f9_topical_entities']}) WHERE rank <= 8 AND sources >= 2 UNION ALL SELECT topic_id, 'relation', rank, subject || ' ' || relation || ' ' || object FROM ({salience.TWINS['f15_extract_relations']}) WHERE rank <= 5",
}
