"""Quality of grams and entities, term sets, budgets and roles (families D, F)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.operators.articles import any_of
from textloom.operators.grams import ranked
from textloom.operators.headings import SPECIAL, words_of

CODE = r"[{}();=<>\\|@#$%^&*]"


def shares_word(text: Column, words: list[str]) -> Column:
    return F.arrays_overlap(words_of(F.lower(text)), F.array(*[F.lit(w) for w in words]))


def clean_grams(grams: DataFrame, stop: list[str], css: list[str], generic: list[str], keyword: list[str]) -> DataFrame:
    """Grams without style words, generic phrases, special characters, bare numbers or stop words only, and without weak or one-sided counts."""
    words = words_of(F.col("gram"))
    own = shares_word(F.col("gram"), keyword)
    bad = F.arrays_overlap(words, F.array(*[F.lit(c) for c in css])) | F.col("gram").isin(generic) | (F.length("gram") < 4) | F.col("gram").rlike(SPECIAL) | F.col("gram").rlike(r"^[\d\s]+$")
    bad = bad | (F.size(F.filter(words, lambda w: ~w.isin(stop))) == 0) | (~own & ((F.col("weight") < 0.05) | (F.col("freq") < 2)))
    bad = bad | ((F.col("sources") == 1) & (F.col("freq_min") >= 20)) | ((F.col("sources") <= 2) & (F.col("freq_min") == F.col("freq_max")) & (F.col("freq_min") >= 15))
    return grams.filter(~bad)


def quality_reason(text: Column, stop: list[str], css: list[str], shop: list[str], nav: list[str], words: Column | None = None, content: Column | None = None) -> Column:
    """The first reason that speaks against a phrase, else null; ``words`` of the lower-case phrase and its ``content`` without stop words if they are columns already."""
    low = F.lower(text)
    words = words_of(low) if words is None else words
    content = F.filter(words, lambda w: ~w.isin(stop)) if content is None else content
    every = lambda listed: F.size(F.filter(words, lambda w: ~w.isin(listed))) == 0
    return (
        F.when(F.length(F.trim(text)) < 3, "too_short")
        .when(F.size(F.filter(words, lambda w: F.length(w) > 2)) == 0, "short_tokens")
        .when((F.size(words) > 1) & (F.size(F.array_distinct(words)) == 1), "repeated_word")
        .when(F.size(F.array_distinct(content)) < F.size(content), "repeated_content_word")
        .when(low.rlike(r"\d+\s?(?:kg|g|cm|mm|ml|l|eur|usd)\b"), "unit")
        .when(F.get(words, F.lit(0)).isin(css), "css_prefix")
        .when(any_of([low.contains(s) for s in shop]), "shop")
        .when(text.rlike(CODE), "code_chars")
        .when(text.rlike("[a-z][A-Z]"), "camel_case")
        .when(text.rlike(r"\w+_\w+_\w+"), "snake_case")
        .when(text.rlike(r"^[\d\s.,;:/-]+$"), "digits")
        .when(every(nav), "navigation")
        .when(F.size(content) == 0, "stop_words")
    )


def flagged_phrases(rows: DataFrame, text: str, stop: list[str], css: list[str], shop: list[str], nav: list[str]) -> DataFrame:
    """The rows against whose ``text`` a reason of ``quality_reason`` speaks, with it as ``reason``.

    A phrase is split into words once; a filter on the reason would be pushed below that and split it for every rule again.
    """
    split = rows.withColumn("__w", words_of(F.lower(text))).withColumn("__c", F.filter("__w", lambda w: ~w.isin(stop)))
    reason = quality_reason(F.col(text), stop, css, shop, nav, F.col("__w"), F.col("__c"))
    return split.select(*rows.columns, F.explode(F.array_compact(F.array(reason))).alias("reason"))


def web_garbage_level(text: Column, blacklist: list[str], stop: list[str]) -> Column:
    """The first of the levels that marks a phrase as remains of a web page, else null."""
    low, n = F.lower(text), F.length(text)
    words = words_of(low)
    odd = (n - F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))) / F.greatest(n, F.lit(1))
    humps = F.size(F.regexp_extract_all(text, F.lit("([a-z][A-Z])"), F.lit(1)))
    capital = F.size(F.filter(words_of(text), lambda w: w.rlike(r"^\p{Lu}")))
    return (
        F.when(low.isin(blacklist), 1).when(text.rlike(CODE), 2)
        .when(odd > F.when(n < 20, 0.08).otherwise(0.12), 3)
        .when(F.arrays_overlap(F.split(low, r"[-_./\s]+"), F.array(*[F.lit(b) for b in blacklist])), 4)
        .when(text.rlike(r"^[\d\s.,:/-]+$"), 5).when(humps >= 2, 6).when(low.rlike("sans-serif|monospace|helvetica"), 7)
        .when(text.rlike("Ã.|â€|Å.|\\x{FFFD}"), 8).when(low.rlike("^(?:0x)?[0-9a-f]{6,}$"), 9).when(text.rlike(r"(?:\.\.\.|…|-)$"), 10)
        .when((F.size(F.array_distinct(words)) < F.size(words)) | (F.size(words) >= 5) | (capital >= 4), 11)
    )


def clean_entities(entities: DataFrame, generic: list[str], stop: list[str], keyword: list[str], text: str = "phrase", score: str = "importance") -> DataFrame:
    """Entities of 3 to 80 characters with a letter, neither generic nor stop words; each text once per topic, the strongest."""
    low = F.lower(text)
    fits = F.length(text).between(3, 80) & F.col(text).rlike(r"\p{L}") & ~F.col(text).rlike(SPECIAL) & ~low.isin(generic)
    fits = fits & (F.size(F.filter(words_of(low), lambda w: ~w.isin(stop))) > 0) & ((F.col(score) >= 0.01) | shares_word(F.col(text), keyword))
    best = entities.filter(fits).groupBy("topic_id", low.alias("__k")).agg(F.max_by(F.struct(*[c for c in entities.columns if c != "topic_id"]), F.struct(score, text)).alias("e"))
    return best.select("topic_id", "e.*")


def drop_flagged(rows: DataFrame, flagged: DataFrame, text: str | Column) -> DataFrame:
    """Rows whose lower-case text is not in ``flagged(flag)``."""
    return rows.join(flagged.select(F.lower("flag").alias("__f")).distinct(), F.lower(text) == F.col("__f"), "left_anti")


def moderated(tables: dict[str, DataFrame], flagged: DataFrame, columns: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, tuple[Observation, Observation]]]:
    """Each of ``tables`` without what ``flagged(kind, flag)`` lists for its name, and what is counted on the way, before and after.

    ``columns`` names the column that is compared, in any case; of numbers, such as a triplet's index, it is the number written out. The
    counts are metrics of the same pass: they can be asked for once the kept rows are written.
    """
    kept, counts = {}, {}
    for kind, rows in tables.items():
        before, after = Observation(), Observation()
        own = flagged.filter(F.col("kind") == kind).select("flag")
        kept[kind] = drop_flagged(rows.observe(before, F.count(F.lit(1)).alias("n")), own, F.col(columns[kind]).cast("string")).observe(after, F.count(F.lit(1)).alias("n"))
        counts[kind] = (before, after)
    return kept, counts


def observed_count(metric: Observation) -> int:
    """The count of a metric of ``moderated``; rows that the optimizer finds empty leave the plan with their metric, and count 0."""
    return metric.get["n"] if metric._jo.getRow().length() else 0


def term_set_coverage(terms: DataFrame, known: DataFrame) -> DataFrame:
    """``(term, covered)``: target terms that some known term equals but for case and outer blanks."""
    rows = terms.select(F.lower(F.trim("term")).alias("term")).filter("term <> ''").distinct()
    asked = rows.select(F.col("term").alias("__t"))
    have = known.select(F.lower(F.trim("gram")).alias("__t")).join(asked, "__t", "left_semi").distinct().withColumn("__h", F.lit(True))
    return rows.join(have, F.col("term") == F.col("__t"), "left").select("term", F.coalesce("__h", F.lit(False)).alias("covered"))


def section_budget(grams: DataFrame, n_sections: int) -> DataFrame:
    """Add ``low, high, per_section``: the range of a gram, from its weight where there is none, and a section's share."""
    none = (F.col("freq_min") == 0) & (F.col("freq_max") == 0)
    low = F.when(none, F.greatest(F.lit(1), F.floor(5 * F.col("weight")))).otherwise(F.col("freq_min"))
    rows = grams.withColumn("low", low.cast("long"))
    high = F.when(none, F.greatest(F.col("low"), F.floor(10 * F.col("weight")))).otherwise(F.col("freq_max"))
    return rows.withColumn("high", high.cast("long")).withColumn("per_section", F.ceil(F.col("high") / max(2, n_sections)).cast("long"))


def key_gram(grams: DataFrame, entity: str) -> DataFrame:
    """``(topic_id, gram)``: the first ranked gram that holds the entity or at least half of its words."""
    words = entity.lower().split()
    shared = F.size(F.array_intersect(words_of(F.col("gram")), F.array(*[F.lit(w) for w in words])))
    rows = grams.filter(F.col("gram").contains(entity.lower()) | (2 * shared >= max(2, len(words))))
    return rows.groupBy("topic_id").agg(F.min_by("gram", "rank").alias("gram"))


def theme_importance(grams: DataFrame, headings: DataFrame, n: int = 10) -> DataFrame:
    """``(topic_id, theme, n_headings, n_grams)``: the ten most frequent words of three letters or more of both lists, and what holds them.

    Both lists are ranked and short per topic; a topic has at most twice ``n`` themes, so the condition join grows with the lists alone.
    """
    def top(rows: DataFrame, text: str) -> DataFrame:
        words = rows.select("topic_id", F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), F.lit(1))).alias("theme"))
        return ranked(words.groupBy("topic_id", "theme").agg(F.count(F.lit(1)).alias("n")), n, F.desc("n"), F.asc("theme")).select("topic_id", "theme")

    themes = top(grams, "gram").union(top(headings, "heading")).distinct()
    texts = grams.select("topic_id", F.lower("gram").alias("t"), F.lit(0).alias("h")).union(headings.select("topic_id", F.lower("heading"), F.lit(1)))
    hit = F.col("t").contains(F.col("theme"))
    rows = themes.join(texts, "topic_id").filter(hit).groupBy("topic_id", "theme")
    return rows.agg(F.sum("h").alias("n_headings"), F.sum(1 - F.col("h")).alias("n_grams"))


def phrase_key(text: Column, stop: list[str]) -> Column:
    """Sorted words over two letters that are no stop words, or null: too short, long or wordy, few letters, or led by a stop word."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s-]", " "), r"\s+", " "))
    words = words_of(clean)
    letters = F.length(F.regexp_replace(clean, r"[^\p{L}]", "")) / F.greatest(F.length(clean), F.lit(1))
    ok = F.length(clean).between(3, 80) & (F.size(words) <= 5) & (letters >= 0.6) & ~((F.size(words) <= 2) & F.get(words, F.lit(0)).isin(stop))
    key = F.array_join(F.array_sort(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop))), " ")
    return F.when(ok & (key != ""), key)


def concept_tiers(entities: DataFrame, limits: tuple[int, int] = (15, 10)) -> DataFrame:
    """``(topic_id, tier, phrase, rank)``: must = two sources and a score of 0.3, should = a score of 0.2."""
    tier = F.when((F.col("sources") >= 2) & (F.col("importance") >= 0.3), "must").when(F.col("importance") >= 0.2, "should")
    rows = entities.withColumn("tier", tier).filter("tier IS NOT NULL")
    order = Window.partitionBy("topic_id", "tier").orderBy(F.desc("importance"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.when(F.col("tier") == "must", limits[0]).otherwise(limits[1]))
    return rows.select("topic_id", "tier", "phrase", "rank")


def placement_roles(entities: DataFrame) -> DataFrame:
    """``(topic_id, phrase, rank, role, in_first_paragraph)`` of the ten first entities."""
    rows = ranked(entities.drop("rank"), 10, F.desc("importance"), F.asc("phrase"))
    role = F.when(F.col("rank") == 1, "primary").when(F.col("rank") <= 4, "secondary").otherwise("supporting")
    return rows.select("topic_id", "phrase", "rank", role.alias("role"), (F.col("rank") <= 3).alias("in_first_paragraph"))


def placement_plan(entities: DataFrame, pairs: DataFrame, concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """``(topic_id, kind, rank, item)``: what an article of a topic places, all lists in one tall table.

    The ten first entities by role, the five first ``pairs(topic_id, a, b, strength)`` of strength 0.2 or more, of the eight first
    ``concepts(topic_id, rank, display, sources)`` those of two sources or more, and five ``relations(topic_id, rank, subject, relation, object)``.
    """
    placed = placement_roles(entities).select("topic_id", F.col("role").alias("kind"), "rank", F.col("phrase").alias("item"))
    joint = ranked(pairs.drop("rank").filter("strength >= 0.2"), 5, F.desc("strength"), F.asc("a"), F.asc("b")).select("topic_id", F.lit("pair").alias("kind"), "rank", F.concat_ws(" + ", "a", "b").alias("item"))
    shared = concepts.filter("rank <= 8 AND sources >= 2").select("topic_id", F.lit("concept").alias("kind"), "rank", F.col("display").alias("item"))
    told = relations.filter("rank <= 5").select("topic_id", F.lit("relation").alias("kind"), "rank", F.concat_ws(" ", "subject", "relation", "object").alias("item"))
    return placed.unionByName(joint).unionByName(shared).unionByName(told)


def coverage_role(entities: DataFrame, n_sources: DataFrame) -> DataFrame:
    """``(topic_id, phrase, role)`` by the share of sources: 70 % must, 40 % should, else a differentiator."""
    share = F.col("sources") / F.col("n_sources")
    role = F.when(share.isNull(), "SHOULD").when(share >= 0.7, "MUST").when(share >= 0.4, "SHOULD").otherwise("DIFFERENTIATOR")
    return entities.join(n_sources, "topic_id", "left").select("topic_id", "phrase", role.alias("role"))


def drop_single_source_names(entities: DataFrame, n_sources: DataFrame) -> DataFrame:
    """Without names of persons and organisations that one source uses at most three times, in topics of three sources or more."""
    lone = (F.col("n_sources") >= 3) & F.col("etype").isin("PERSON", "ORGANIZATION") & (F.col("sources") == 1) & (F.col("freq") <= 3)
    return entities.join(n_sources, "topic_id").filter(~lone).drop("n_sources")


def strong_pairs(pairs: DataFrame, limit: int = 8) -> DataFrame:
    return ranked(pairs.drop("rank").filter((F.col("strength") >= 0.2) & (F.col("n") >= 3)), limit, F.desc("strength"), F.asc("a"), F.asc("b"))


def must_cover(tiers: DataFrame, entities: DataFrame, main: str, limit: int = 12) -> DataFrame:
    """``(topic_id, phrase, rank)``: the main entity, then must, should and plain entities, each text once, six of a kind."""
    kinds = tiers.filter("rank <= 6").select("topic_id", "phrase", F.when(F.col("tier") == "must", 1).otherwise(2).alias("kind"), "rank")
    rows = kinds.union(entities.filter("rank <= 6").select("topic_id", "phrase", F.lit(3), "rank"))
    rows = rows.union(entities.select("topic_id").distinct().select("topic_id", F.lit(main), F.lit(0), F.lit(1)))
    first = rows.groupBy("topic_id", "phrase").agg(F.min(F.struct("kind", "rank")).alias("o"))
    return ranked(first, limit, F.asc("o"), F.asc("phrase")).select("topic_id", "phrase", "rank")


def noun_runs(toks: DataFrame, noun: str, modifier: str) -> DataFrame:
    """``(topic_id, src_idx, phrase)``: maximal runs of two to five words that match ``modifier`` or ``noun`` and end in a noun.

    The patterns stand for a tagger's lexicon; runs are cut inside a document's own row.
    """
    marked = F.array_join(F.transform("words", lambda w: F.when(w.rlike(noun) | w.rlike(modifier), w).otherwise("|")), " ")
    runs = F.transform(F.split(marked, r"(?:^| )\|(?= |$)"), lambda r: F.trim(r))
    rows = toks.select("topic_id", "src_idx", F.explode(F.filter(runs, lambda r: r != "")).alias("phrase"))
    words = F.split("phrase", " ")
    return rows.filter(F.size(words).between(2, 5) & F.element_at(words, -1).rlike(noun))


def lexicon_runs(toks: DataFrame, lexicon: DataFrame | Callable[[Column], Column], kinds: tuple[str, ...] = ("ADJ", "NOUN", "PROPN"), last: tuple[str, ...] = ("NOUN", "PROPN")) -> DataFrame:
    """``(topic_id, src_idx, doc_id, pos, phrase, key)``: maximal runs of two to five words of ``kinds`` that are no stop words and end in one of ``last``.

    Words meet ``lexicon(surface, lemma, pos, is_stop)`` by an equal-key join that the optimizer plans by the lexicon's size; only listed words go on. A run is
    an island: place less number among the listed words of its text stays the same. ``key`` holds its lemmas. Texts are told by topic, source and id.
    A ``lexicon`` by rule, from a word to ``(lemma, pos, is_stop)``, is joined to nothing, and only listed words beside another one leave their text's row.
    """
    text = ["topic_id", "src_idx", "doc_id"]
    if callable(lexicon):
        listed = lambda w: F.coalesce(lexicon(w)["pos"].isin(*kinds) & ~lexicon(w)["is_stop"], F.lit(False))
        beside = F.arrays_zip(F.col("words").alias("word"), F.slice("words", 2, 1 << 30).alias("after"), F.concat(F.array(F.lit(None).cast("string")), "words").alias("before"))
        places = toks.select(*text, F.posexplode(beside).alias("pos", "w")).select(*text, "pos", "w.*")
        alone = ~listed(F.col("after")) & ~listed(F.col("before"))
        word = lexicon(F.col("word"))
        words = places.filter(listed(F.col("word")) & ~alone).select(*text, "pos", "word", word["lemma"].alias("lemma"), word["pos"].alias("tag"))
    else:
        known = lexicon.filter(F.col("pos").isin(*kinds) & ~F.col("is_stop")).select(F.col("surface").alias("word"), "lemma", F.col("pos").alias("tag")).dropDuplicates(["word"])
        words = toks.select(*text, F.posexplode("words").alias("pos", "word")).join(known, "word")
    isles = words.withColumn("isle", F.col("pos") - F.row_number().over(Window.partitionBy(*text).orderBy("pos")))
    runs = isles.groupBy(*text, "isle").agg(F.count(F.lit(1)).alias("n"), F.max_by("tag", "pos").alias("tag"), F.array_sort(F.collect_list(F.struct("pos", "word", "lemma"))).alias("w"))
    rows = runs.filter(F.col("n").between(2, 5) & F.col("tag").isin(*last))
    joined = lambda c: F.array_join(F.transform("w", lambda x: x[c]), " ")
    return rows.select(*text, F.col("w")[0]["pos"].cast("long").alias("pos"), joined("word").alias("phrase"), joined("lemma").alias("key"))


def noun_phrases(toks: DataFrame, lexicon: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """``(topic_id, phrase, key, n)`` of ``lexicon_runs``."""
    return lexicon_runs(toks, lexicon).groupBy("topic_id", "phrase", "key").agg(F.count(F.lit(1)).alias("n"))


def signal_sources(signals: DataFrame, cap: int = 20_000) -> DataFrame:
    """``(topic_id, content)``: a topic's signal texts in order, joined with `` . ``, while the size before them is under ``cap``.

    A text has one character at least, so the rank limit loses nothing.
    """
    order = Window.partitionBy("topic_id").orderBy("pos")
    rows = signals.filter(F.length("text") > 0).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= cap)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).filter(F.col("before") < cap)
    rows = rows.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("t"))
    return rows.select("topic_id", F.array_join(F.transform("t", lambda x: x["text"]), " . ").alias("content"))


#: How many rows of each list a consumer gets.
LIST_LIMITS = {"grams": 25, "extended": 15, "headings": 20, "scored": 15, "entities": 20, "concepts": 20, "unanswered": 8, "subtopics": 8, "shallow": 5, "gaps": 15, "semantic_gaps": 10, "pairs": 15, "clusters": 8, "snippets": 5, "competitors": 10}


def trim_lists(tables: dict[str, DataFrame], columns: dict[str, list[str]], limits: dict[str, int] = LIST_LIMITS) -> dict[str, DataFrame]:
    """Of each table with ``topic_id`` and ``rank`` the first rows of a topic and the columns that a consumer needs; a range of counts is one text.

    A list without a limit is handed on whole.
    """
    out = {}
    for name, rows in tables.items():
        kept = rows.filter(F.col("rank") <= limits[name]) if name in limits else rows
        if {"freq_min", "freq_max"} <= set(rows.columns):
            kept = kept.withColumn("range", F.concat_ws("-", "freq_min", "freq_max"))
        out[name] = kept.select("topic_id", "rank", *columns[name])
    return out


def trim_for_consumer(grams: DataFrame, limit: int = 25) -> DataFrame:
    """``(topic_id, gram, range)``: the first grams without technical columns, counts as a range string."""
    return grams.filter(F.col("rank") <= limit).select("topic_id", "gram", F.concat_ws("-", "freq_min", "freq_max").alias("range"))
