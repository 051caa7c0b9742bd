"""Fixes by place, issues of an audit, and what a proofreader must keep or know (family I); references (family H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.grams import ranked
from textloom.operators.headings import words_of


def apply_offset_fixes(articles: DataFrame, fixes: DataFrame, kinds: tuple = ("GRAMMAR", "TYPOS"), key: str = "doc_id") -> DataFrame:
    """``(key, text, applied)``: from the last place to the first, a fix replaces its stretch.

    ``fixes(key, place, length, category, sentence, replacements)``, places from 0. A fix applies if it is of a known
    kind, has one replacement whose length differs by twice the stretch's at most, and the stretch stands in its sentence.
    One fold per article over its own fixes.
    """
    safe = F.col("category").isin(*kinds) & (F.size("replacements") == 1) & (F.abs(F.length(F.get("replacements", F.lit(0))) - F.col("length")) <= 2 * F.col("length"))
    each = F.struct((-F.col("place")).alias("order"), "length", F.get("replacements", F.lit(0)).alias("new"), F.lower("sentence").alias("sentence"))
    todo = fixes.filter(safe).groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("todo"))
    start = F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("applied"))

    def step(acc: Column, f: Column) -> Column:
        at = -f["order"]
        old = F.substring(acc["text"], at + 1, f["length"])
        fits = (at >= 0) & (at + f["length"] <= F.length(acc["text"])) & F.contains(f["sentence"], F.lower(F.trim(old)))
        made = F.concat(F.substring(acc["text"], F.lit(1), at), f["new"], F.substring(acc["text"], at + f["length"] + 1, F.length(acc["text"])))
        return F.when(fits, F.struct(made.alias("text"), (acc["applied"] + 1).alias("applied"))).otherwise(acc)

    rows = articles.join(todo, key, "left").withColumn("todo", F.coalesce("todo", F.array().cast(todo.schema["todo"].dataType)))
    return rows.select(key, F.aggregate("todo", start, step).alias("r")).select(key, "r.text", "r.applied")


def collect_issues(audits: DataFrame, kinds: dict[str, str], key: str = "doc_id") -> DataFrame:
    """``(key, kind, severity, text)``: the lists of strings in the columns ``kinds`` (column to severity) as one tall table."""
    def rows_of(kind: str, severity: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), x.alias("text")))

    each = [rows_of(*k) for k in kinds.items()]
    return audits.select(key, F.explode(F.concat(*each)).alias("i")).select(key, "i.*")


def protected_phrases(topics: DataFrame, grams: DataFrame, variants: DataFrame, most: tuple[int, int] = (15, 10)) -> DataFrame:
    """``(topic_id, phrase)``: what no correction may touch.

    ``topics(topic_id, phrase)`` has keywords, entities and key grams; of ``grams(topic_id, rank, phrase)`` and
    ``variants(topic_id, rank, phrase)`` the first ones of over three characters.
    """
    some = [rows.filter((F.col("rank") <= n) & (F.length("phrase") > 3)).select("topic_id", "phrase") for rows, n in zip((grams, variants), most)]
    return topics.filter("phrase <> ''").select("topic_id", "phrase").unionByName(some[0]).unionByName(some[1]).distinct()


def reference_facts(facts: DataFrame, triples: DataFrame, causal: DataFrame, lines: DataFrame, marks: dict[str, list[str]], most: tuple[int, ...] = (20, 15, 10, 10)) -> DataFrame:
    """``(topic_id, kind, rank, text)``: the first facts, triples and causal links, and lines that hold a term of one of the lists of ``marks``.

    The first three are ``(topic_id, rank, text)``, lines ``(topic_id, line)``; every partition drops all but its first ones.
    """
    low = F.lower("line")
    kinds = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms]), F.lit(k)) for k, terms in marks.items()]
    held = lines.withColumn("kind", F.explode(F.array_compact(F.array(*kinds)))).select(F.struct("topic_id", "kind").alias("topic_id"), F.col("line").alias("text")).distinct()
    held = ranked(held, most[3], F.asc("text")).select("topic_id.topic_id", "topic_id.kind", "rank", "text")
    for kind, rows, n in zip(("fact", "triple", "causal"), (facts, triples, causal), most):
        held = held.unionByName(rows.filter(F.col("rank") <= n).select("topic_id", F.lit(kind).alias("kind"), "rank", "text"))
    return held


def match_references(keyword: Column, references: list[tuple[str, str]], limit: int = 6) -> Column:
    """The acts of ``references`` (phrase, act) whose phrase is part of the keyword or holds it, else those that share a word of three letters with it."""
    low = F.lower(F.trim(keyword))
    longer = lambda c: F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]{3,})"), F.lit(1))
    part = F.array(*[F.when(F.contains(low, F.lit(p)) | ((low != "") & F.contains(F.lit(p), low)), F.lit(a)) for p, a in references])
    word = F.array(*[F.when(F.arrays_overlap(longer(low), longer(F.lit(p))), F.lit(a)) for p, a in references])
    direct, loose = (F.slice(F.array_distinct(F.array_compact(x)), 1, limit) for x in (part, word))
    return F.when(F.size(direct) > 0, direct).otherwise(loose)


def relevant_publications(pubs: DataFrame, topics: DataFrame, terms: list[tuple[str, str]], evidence: list[str], limit: int = 20, small: bool = False) -> DataFrame:
    """``(topic_id, rank, id, evidence, share)`` of ``pubs(topic_id, id, body)``: those that hold words of the topic's keyword, the strongest evidence first.

    Terms of the keyword are translated, the longest first. A text stays if a longer word of either form stands in it,
    and of two or more translated words 30 %. ``evidence`` lists the labels, the strongest first; the last is the default. ``small`` says that
    the caller has checked that ``topics`` can be broadcast; otherwise texts are shuffled by their topic.
    """
    turned = reduce(lambda c, t: F.replace(c, F.lit(t[0]), F.lit(t[1])), sorted(terms, key=lambda t: (-len(t[0]), t[0])), F.lower("keyword"))
    longer = lambda c: F.filter(words_of(c), lambda w: F.length(w) > 3)
    known = topics.select("topic_id", longer(F.lower("keyword")).alias("own"), longer(turned).alias("words"))
    rows = pubs.withColumn("low", F.lower("body")).join(F.broadcast(known) if small else known, "topic_id")
    found = lambda c: F.size(F.filter(c, lambda w: F.contains("low", w)))
    share = found("words") / F.greatest(F.size("words"), F.lit(1))
    rows = rows.filter(((found("words") > 0) | (found("own") > 0)) & ((F.size("words") < 2) | (share >= 0.3)))
    level = F.coalesce(*[F.when(F.contains("low", F.lit(e)), k) for k, e in enumerate(evidence[:-1])], F.lit(len(evidence) - 1))
    rows = rows.select("topic_id", "id", level.alias("level"), F.round(share, 4).alias("share"))
    rows = ranked(rows, limit, F.asc("level"), F.desc("share"), F.asc("id"))
    return rows.select("topic_id", "rank", "id", F.get(F.array(*[F.lit(e) for e in evidence]), F.col("level")).alias("evidence"), "share")
