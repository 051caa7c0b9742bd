"""Concepts, salience, relations and the main entity of a topic (family F)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.operators.grams import numbered, ranked
from textloom.operators.headings import words_of
from textloom.operators.terms import phrase_key

#: Fixed value: letters that are no vowels, as a class of a pattern.
CONSONANTS = "[bcdfghjklmnpqrstvwxzßçñśźżćńł]"


def looks_mistyped(phrase: Column) -> Column:
    """A word of the phrase has four consonants in a row after its first ones."""
    return F.regexp_replace(F.lower(phrase), f"(^| ){CONSONANTS}+", "$1").rlike(f"{CONSONANTS}{{4}}")


def keyword_words(stop: list[str]) -> Column:
    """Words of the column ``keyword`` over two letters that are no stop words."""
    return F.filter(words_of(F.lower("keyword")), lambda w: (F.length(w) > 2) & ~w.isin(stop))


def topical_entities(mentions: DataFrame, topics: DataFrame, stop: list[str], limit: int = 30) -> DataFrame:
    """``(topic_id, rank, key, display, variants, etype, freq, sources, importance)`` of ``mentions(topic_id, src_idx, phrase)``.

    Phrases with the same sorted lemmas are one concept, shown as most often written without a typing error.
    Counts are combined by source and by written form before a concept's rows meet; at most five forms of it are kept.
    """
    keyed = mentions.withColumn("key", phrase_key(F.col("phrase"), stop)).filter("key IS NOT NULL")
    per = keyed.groupBy("topic_id", "key", "src_idx", "phrase").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("topic_id", "key").agg(F.sum("n").alias("freq"), F.countDistinct("src_idx").alias("sources"), F.max(F.size(words_of(F.col("phrase")))).alias("words")).filter("freq >= 2")
    forms = per.groupBy("topic_id", "key", "phrase").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("topic_id", "key").orderBy(F.desc("n"), "phrase")
    best = forms.groupBy("topic_id", "key").agg(F.min_by("phrase", F.struct(looks_mistyped(F.col("phrase")), -F.col("n"), "phrase")).alias("display"))
    five = forms.withColumn("k", F.row_number().over(order)).filter("k <= 5").groupBy("topic_id", "key").agg(F.array_join(F.array_sort(F.collect_list("phrase")), ", ").alias("variants"))
    rows = total.join(best, ["topic_id", "key"]).join(five, ["topic_id", "key"]).join(topics, "topic_id")
    own = keyword_words(stop)
    shared = F.size(F.array_intersect(words_of(F.col("display")), own))
    length = F.when(F.col("words") == 2, 0.20).when(F.col("words") == 3, 0.18).when(F.col("words") == 1, 0.10).otherwise(0.08)
    score = 0.35 * F.col("sources") / F.col("n_sources") + F.least(F.lit(0.25), 0.06 * F.log(F.col("freq") + 1)) + length + 0.2 * shared / F.greatest(F.size(own), F.lit(1))
    rows = rows.withColumns({"importance": F.round(F.least(F.lit(1.0), score), 6), "etype": F.when(F.col("words") <= 2, "CONCEPT").otherwise("TOPICAL")})
    rows = ranked(rows, limit, F.desc("importance"), F.asc("key"))
    return rows.select("topic_id", "rank", "key", "display", "variants", "etype", "freq", "sources", "importance")


def running_position(places: DataFrame, weights: DataFrame) -> DataFrame:
    """``(topic_id, display, position, early)``: a mean that starts at 1 and takes in the ``first`` places of sources in their order.

    Of ``places(topic_id, display, src_idx, first, early)``. Each step weighs what is so far with one less than the concept's ``sources`` in
    ``weights`` and the new place with 1. Such steps compose: a place that k others follow counts with the k-th power of the old
    share, so the mean is a sum that partial aggregation may split, and only places in the order of sources, two numbers a source, meet.
    """
    follow = Window.partitionBy("topic_id", "display").orderBy(F.desc("src_idx"))
    rows = places.withColumn("k", F.row_number().over(follow) - 1).join(weights.select("topic_id", "display", F.greatest(F.col("sources") - 1, F.lit(0)).alias("w")), ["topic_id", "display"])
    old = F.col("w") / (F.col("w") + 1)
    sums = rows.groupBy("topic_id", "display", "w").agg(F.sum(F.col("first") / (F.col("w") + 1) * F.pow(old, F.col("k"))).alias("new"), F.count(F.lit(1)).alias("n"), F.sum("early").alias("early"))
    return sums.select("topic_id", "display", (F.col("new") + F.pow(old, F.col("n"))).alias("position"), "early")


def salience_topical(concepts: DataFrame, sources: DataFrame, headings: DataFrame, topics: DataFrame, early: int = 1500, nav: list[str] = [], least_chars: int = 100, small: bool = False) -> DataFrame:
    """``(topic_id, display, position, early, in_h1, in_h2, salience, rank)`` of the few ``concepts(topic_id, display, sources)`` of each topic.

    A topic's concepts travel as one short array, so sources and headings keep one row each until a concept is
    found in them. ``position`` is the running mean of the first places as shares of texts of ``least_chars`` or more. Concepts of under three
    characters, of ``nav`` words alone or with a word that begins with a dot are left out. ``small`` says that the caller has checked that
    the topics are few, so that their arrays are broadcast; otherwise texts are shuffled by their topic.
    """
    parts = F.filter(F.split(F.lower("display"), r"[.\s]+"), lambda w: w != "")
    plain = (F.size(parts) == 0) | (F.size(F.array_except(parts, F.array(*[F.lit(w) for w in nav]).cast("array<string>"))) > 0)
    concepts = concepts.filter((F.length("display") >= 3) & plain & ~F.col("display").rlike(r"(?:^|\s)\."))
    sources = sources.filter(F.length("content") >= least_chars)
    listed = concepts.groupBy("topic_id").agg(F.collect_set("display").alias("known"))  # as many as the concepts' rank limit
    listed = F.broadcast(listed) if small else listed

    def holding(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
        found = F.filter(F.transform("known", lambda k: F.struct(k.alias("display"), (F.instr(text, k) - 1).alias("at"))), lambda x: x["at"] >= 0)
        return rows.join(listed, "topic_id").select("topic_id", *keep, F.explode(found).alias("f")).select("topic_id", *keep, "f.*")

    places = holding(sources.withColumn("low", F.lower("content")).withColumn("size", F.length("content")), F.col("low"), "src_idx", "size")
    places = places.groupBy("topic_id", "display", "src_idx").agg(F.min(F.col("at") / F.greatest("size", F.lit(1))).alias("first"), F.max(F.col("at") < early).cast("long").alias("early"))
    places = running_position(places, concepts)
    heads = holding(headings.withColumn("low", F.lower("heading")), F.col("low"), "level").groupBy("topic_id", "display").agg(F.count_if(F.col("level") == 1).alias("in_h1"), F.count_if(F.col("level") == 2).alias("in_h2"))
    rows = concepts.join(places, ["topic_id", "display"], "left").join(heads, ["topic_id", "display"], "left").join(topics, "topic_id")
    rows = rows.withColumn("position", F.coalesce("position", F.lit(1.0))).fillna(0, ["early", "in_h1", "in_h2"])
    words = words_of(F.lower("keyword"))
    share = lambda c: F.least(F.lit(1.0), F.col(c) / F.greatest("n_sources", F.lit(1)))
    overlap = F.least(F.lit(1.0), F.size(F.array_intersect(words_of(F.col("display")), words)) / F.greatest(F.size(words), F.lit(1)))
    score = 0.25 * F.col("sources") / F.col("n_sources") + 0.2 * (1 - F.col("position")) + 0.15 * share("early") + 0.15 * share("in_h1") + 0.15 * share("in_h2") + 0.1 * overlap
    rows = rows.withColumn("salience", F.round(F.least(F.lit(1.0), score), 6)).withColumn("position", F.round("position", 6))
    return numbered(rows.drop("rank"), F.desc("salience"), F.asc("display")).select("topic_id", "display", "position", "early", "in_h1", "in_h2", "salience", "rank")


def roles_in_sentences(sents: DataFrame, phrases: list[str]) -> DataFrame:
    """``(topic_id, src_idx, phrase, place, subject)`` of ``sents(topic_id, src_idx, pos, n, sentence)``: where a phrase stands, and whether in the first five words."""
    low = F.lower("sentence")
    head = F.array_join(F.slice(words_of(low), 1, 5), " ")
    found = F.filter(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(low, p))
    rows = sents.select("topic_id", "src_idx", "pos", (F.col("pos") / F.greatest("n", F.lit(1))).alias("place"), head.alias("head"), F.explode(found).alias("phrase"))
    return rows.select("topic_id", "src_idx", "phrase", "place", "pos", F.contains("head", "phrase").alias("subject"))


def salience_roles(mentions: DataFrame, headings: DataFrame, topics: DataFrame) -> DataFrame:
    """``(topic_id, phrase, position, subject_ratio, in_h1, in_h2, salience, rank)`` of the rows of ``roles_in_sentences``.

    Headings hold a phrase if they hold its words without their last three letters.
    """
    per = mentions.groupBy("topic_id", "phrase", "src_idx").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if("subject").alias("led"), F.max(F.col("pos") < 3).cast("long").alias("early"))
    rows = per.groupBy("topic_id", "phrase").agg(F.avg("first").alias("position"), F.sum("n").alias("n"), F.sum("led").alias("led"), F.sum("early").alias("early"), F.count(F.lit(1)).alias("sources"))
    listed = rows.groupBy("topic_id").agg(F.collect_set("phrase").alias("known"))  # as many as the phrases asked for
    stems = lambda p: F.transform(words_of(p), lambda w: F.when(F.length(w) > 5, w.substr(F.lit(1), F.length(w) - 3)).otherwise(w))
    held = F.filter("known", lambda p: F.forall(stems(p), lambda s: F.exists(words_of(F.lower("heading")), lambda w: w.startswith(s))))
    heads = headings.join(listed, "topic_id").select("topic_id", "level", F.explode(held).alias("phrase")).groupBy("topic_id", "phrase").agg(F.count_if(F.col("level") == 1).alias("in_h1"), F.count_if(F.col("level") == 2).alias("in_h2"))
    rows = rows.join(heads, ["topic_id", "phrase"], "left").fillna(0, ["in_h1", "in_h2"]).join(topics, "topic_id")
    spread, ratio = F.col("sources") / F.col("n_sources"), F.col("led") / F.col("n")
    score = 0.25 * (1 - F.col("position")) + F.when(F.col("in_h1") > 0, 0.15).otherwise(0.0) + F.least(F.lit(0.05), 0.02 * F.col("in_h2")) + 0.15 * ratio + 0.2 * spread
    score = score + F.when(spread < 0.5, F.least(F.lit(0.05), -0.02 * F.log(spread + 0.01))).otherwise(0.0) + 0.1 * F.least(F.lit(1.0), F.col("early") / F.col("n_sources"))
    score = score + F.when(F.arrays_overlap(words_of(F.col("phrase")), words_of(F.lower("keyword"))), 0.05).otherwise(0.0)
    rows = rows.withColumns({"salience": F.round(F.least(F.lit(1.0), score), 6), "position": F.round("position", 6), "subject_ratio": F.round(ratio, 6)})
    return numbered(rows, F.desc("salience"), F.asc("phrase")).select("topic_id", "phrase", "position", "early", "subject_ratio", "in_h1", "in_h2", "salience", "rank")


def early_entities(salience: DataFrame, limit: int = 6, default: int = 70) -> DataFrame:
    """``(topic_id, rank, phrase, subject_pct)``: what stands in the first fifth of texts, or early in three sources; the share of subjects in per cent."""
    rows = salience.drop("rank").filter((1 - F.col("position") >= 0.8) | (F.col("early") >= 3))
    pct = F.when(F.col("subject_ratio") > 0, F.floor(100 * F.col("subject_ratio"))).otherwise(default)
    return ranked(rows.withColumn("subject_pct", pct.cast("long")), limit, F.desc("salience"), F.asc("phrase")).select("topic_id", "rank", "phrase", "subject_pct")


def main_entity(salience: DataFrame, entities: DataFrame, headings: DataFrame, topics: DataFrame, reason: Column) -> DataFrame:
    """``(topic_id, entity, origin)``: the most salient, else the most important natural phrase, else the keyword.

    ``reason`` speaks against a ``phrase``. The keyword replaces a phrase that is part of it, shares a word with it or stands in no heading.
    """
    rows = salience.select("topic_id", "phrase", F.lit(0).alias("kind"), "rank").unionByName(entities.select("topic_id", "phrase", F.lit(1).alias("kind"), "rank"))
    rows = rows.filter(reason.isNull() & (F.size(words_of(F.col("phrase"))) <= 4))
    first = rows.groupBy("topic_id").agg(F.min_by("phrase", F.struct("kind", "rank", "phrase")).alias("phrase"))
    shown = headings.join(first, "topic_id").filter(F.contains(F.lower("heading"), F.lower("phrase"))).select("topic_id").distinct().withColumn("shown", F.lit(True))
    rows = topics.join(first, "topic_id", "left").join(shown, "topic_id", "left")
    part = F.contains(F.lower("keyword"), F.lower("phrase")) | F.arrays_overlap(words_of(F.lower("keyword")), words_of(F.lower("phrase")))
    origin = F.when(F.col("phrase").isNull(), "keyword only").when(part, "keyword holds it").when(F.col("shown").isNull(), "in no heading").otherwise("phrase")
    return rows.select("topic_id", F.when(origin == "phrase", F.col("phrase")).otherwise(F.lower("keyword")).alias("entity"), origin.alias("origin"))


def extract_relations(docs: DataFrame, patterns: list[tuple[str, str]], entities: list[str], limit: int = 20, frequent: int = 50) -> DataFrame:
    """``(topic_id, relation, subject, object, n, rank)`` of ``docs(topic_id, text)``; ``patterns`` are (relation, pattern with two groups).

    A relation stays if its subject or object holds an entity or one of the topic's most frequent longer words.
    """
    clip = lambda c: F.substring(F.trim(F.lower(c)), 1, 50)

    def found(kind: str, pattern: str) -> Column:
        sides = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (1, 2)]
        return F.transform(F.arrays_zip(sides[0].alias("a"), sides[1].alias("b")), lambda z: F.struct(F.lit(kind).alias("relation"), clip(z["a"]).alias("subject"), clip(z["b"]).alias("object")))

    rows = docs.select("topic_id", F.explode(F.concat(*[found(*p) for p in patterns])).alias("r")).select("topic_id", "r.*")
    rows = rows.filter((F.length("subject") > 2) & (F.length("object") > 2)).groupBy("topic_id", "relation", "subject", "object").agg(F.count(F.lit(1)).alias("n"))
    words = docs.select("topic_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{5,})"), F.lit(1))).alias("w")).groupBy("topic_id", "w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    often = ranked(words, frequent, F.desc("n"), F.asc("w")).groupBy("topic_id").agg(F.collect_list("w").alias("often"))  # at most ``frequent``
    rows = rows.join(often, "topic_id", "left").withColumn("often", F.coalesce("often", F.array().cast("array<string>")))
    both = F.concat_ws(" | ", "subject", "object")
    named = reduce(lambda a, b: a | b, [F.contains(both, F.lit(e)) for e in entities if len(e) > 4], F.lit(False))
    kept = rows.filter(named | F.exists("often", lambda w: F.contains(both, w))).drop("often")
    return ranked(kept, limit, F.desc("n"), F.asc("relation"), F.asc("subject"), F.asc("object"))


def match_brands(queries: DataFrame, brands: list[str], text: str = "text") -> DataFrame:
    """``(topic_id, brand)``: listed brands that occur in a topic's queries, each once."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.lit(b.lower()) for b in brands]), lambda b: F.contains(low, b))
    return queries.select("topic_id", F.explode(found).alias("brand")).distinct()
