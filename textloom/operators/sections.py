"""Sections of articles, scored headings and what belongs to which section (families A, E, H, J)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.gaps import content_words, word_pairs
from textloom.operators.grams import numbered, ranked
from textloom.operators.headings import words_of
from textloom.operators.lineage import materialise

#: Words by which lines and headings meet, and the same in a lower-case line of ASCII alone, found faster.
LONG_WORD, PLAIN_LONG_WORD = regex.compile(r"\p{L}{3,}"), re.compile(r"[a-z]{3,}")


def outline(text: Column) -> Column:
    """Of a markdown text ``h1, intro, sections(heading, text), paragraphs, words``, in the text's own row.

    The intro stands between the first-level heading and the first second-level one; sections start at the latter;
    paragraphs are parted by blank lines and are no second-level headings.
    """
    body = F.coalesce(text, F.lit(""))
    h1 = F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.+)$", 1))
    parts = F.split(F.concat(F.lit("\n"), body), r"\n##[ \t]+")
    intro = F.when(h1 != "", F.trim(F.regexp_replace(F.get(parts, F.lit(0)), r"(?s)^.*?(?:^|\n)#[ \t]+[^\n]*", ""))).otherwise("")
    heads = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    sections = F.transform(heads, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^([^\n]*)", 1)).alias("heading"), F.trim(F.regexp_replace(s, r"^[^\n]*", "")).alias("text")))
    paragraphs = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.startswith("## ") & ~p.rlike(r"^#[ \t][^\n]*$"))
    return F.struct(h1.alias("h1"), intro.alias("intro"), sections.alias("sections"), paragraphs.alias("paragraphs"), F.size(words_of(body)).alias("words"))


def split_articles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, part, pos, heading, body)``: title, intro, sections and paragraphs of each article, one row each."""
    rows = docs.select(key, outline(F.col(text)).alias("o"))
    one = lambda part, heading, body: F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("pos"), heading.alias("heading"), body.alias("body"))
    head = F.filter(F.array(one("title", F.col("o.h1"), F.lit("")), one("intro", F.lit(""), F.col("o.intro"))), lambda x: (x["heading"] != "") | (x["body"] != ""))
    sections = F.transform("o.sections", lambda s, i: F.struct(F.lit("section").alias("part"), i.cast("long").alias("pos"), s["heading"].alias("heading"), s["text"].alias("body")))
    paragraphs = F.transform("o.paragraphs", lambda p, i: F.struct(F.lit("paragraph").alias("part"), i.cast("long").alias("pos"), F.lit("").alias("heading"), p.alias("body")))
    return rows.select(key, F.explode(F.concat(head, sections, paragraphs)).alias("r")).select(key, "r.*")


def synthesize_sources(signals: DataFrame, sources: DataFrame, least: int = 50) -> DataFrame:
    """``(topic_id, pos, content)`` for topics without sources: titles and snippets paired by place, longer than ``least``.

    ``signals(topic_id, kind, pos, text)`` with the kinds title and snippet.
    """
    pairs = signals.filter(F.col("kind").isin("title", "snippet")).groupBy("topic_id", "pos").agg(F.max(F.when(F.col("kind") == "title", F.col("text"))).alias("title"), F.max(F.when(F.col("kind") == "snippet", F.col("text"))).alias("snippet"))
    rows = pairs.select("topic_id", "pos", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("snippet", F.lit(""))).alias("content"))
    return rows.filter(F.length("content") > least).join(sources.select("topic_id").distinct(), "topic_id", "left_anti")


def score_headings(candidates: DataFrame, lists: DataFrame) -> DataFrame:
    """``(topic_id, rank, heading, pool, base, boost, score, class)`` of ``candidates(topic_id, pool, k, heading, n)``.

    Pool 1 holds headings of ``n`` sources, pools 2 to 4 open questions, suggestions and shallow headings. A heading stays in
    its first pool. ``lists(topic_id, grams, entities, related)`` are short arrays; holding one of each adds once.
    """
    most = F.when(F.col("pool") == 2, 8).when(F.col("pool") == 3, 6).when(F.col("pool") == 4, 5)
    rows = candidates.filter((most.isNull() | (F.col("k") <= most)) & (F.trim("heading") != ""))
    first = rows.groupBy("topic_id", F.lower(F.trim("heading")).alias("low")).agg(F.min(F.struct("pool", "k", "heading", "n")).alias("c"))
    rows = first.select("topic_id", "low", "c.*").join(lists, "topic_id", "left")
    holds = lambda c: F.coalesce(F.exists(c, lambda p: F.contains("low", p)), F.lit(False))
    base = F.when(F.col("pool") == 1, F.least(F.col("n") * 0.11, F.lit(0.88))).when(F.col("pool") == 2, 0.5).when(F.col("pool") == 3, 0.35).otherwise(0.25)
    boost = F.when(holds("grams"), 0.12).otherwise(0.0) + F.when(holds("entities"), 0.10).otherwise(0.0) + F.when(holds("related"), 0.08).otherwise(0.0)
    rows = rows.withColumns({"base": F.round(base, 3), "boost": F.round(boost, 3), "score": F.round(F.least(F.lit(1.0), base + boost), 3)})
    asked = F.when((F.col("pool") == 2) & ~F.col("heading").endswith("?"), F.concat("heading", F.lit("?"))).otherwise(F.col("heading"))
    rows = rows.withColumn("heading", asked).withColumn("class", F.when(F.col("score") >= 0.65, "must").when(F.col("score") >= 0.4, "high").otherwise("optional"))
    return numbered(rows, F.desc("score"), F.asc("pool"), F.asc("k"), F.asc("low")).select("topic_id", "rank", "heading", "pool", "base", "boost", "score", "class")


def raw_fallback(scored: DataFrame, raw: DataFrame) -> DataFrame:
    """The scored headings, and those of ``raw``, scored from unfiltered ones, for topics that have none."""
    return scored.unionByName(raw.join(scored.select("topic_id").distinct(), "topic_id", "left_anti"))


def assign_to_sections(plan: DataFrame, items: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``(topic_id, section, kind, rank, item)``: an item belongs where a longer word of the section's heading stands in it.

    ``plan(topic_id, section, heading)`` is short and travels as an array; ``items(topic_id, kind, k, item)``, whose ``snippet``, if there is one, is
    searched too. A fact goes to its first section only; each kind has its limit.
    """
    said = F.lower(F.concat_ws(" ", "item", "snippet") if "snippet" in items.columns else F.col("item"))
    short = plan.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("section", F.filter(words_of(F.lower("heading")), lambda w: F.length(w) > 3).alias("words")))).alias("plan"))
    fits = F.filter("plan", lambda s: F.exists(s["words"], lambda w: F.contains("said", w)))
    rows = items.withColumn("said", said).join(short, "topic_id").withColumn("fits", F.transform(fits, lambda s: s["section"]))
    rows = rows.withColumn("section", F.explode(F.when(F.col("kind") == "fact", F.slice("fits", 1, 1)).otherwise(F.col("fits"))))
    most = reduce(lambda c, k: c.when(F.col("kind") == k, limits[k]), limits, F.when(F.lit(False), 0)).otherwise(0)
    asked = rows.select(F.struct("topic_id", "section", "kind").alias("__g"), "k", "item", most.alias("most")).withColumnRenamed("__g", "topic_id")
    return ranked(asked, max(limits.values()), F.asc("k"), F.asc("item")).filter(F.col("rank") <= F.col("most")).select("topic_id.topic_id", "topic_id.section", "topic_id.kind", "rank", "item")


def heading_norm(heading: Column) -> Column:
    """The lower-case words of a heading."""
    return F.trim(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}]+", " "))


class HeadingIndex:
    """The headings of a topic under pairs of their words: a line that holds enough words of one holds one of its pairs."""

    def __init__(self, norms: list[tuple[int, str]]):
        self.partners: dict[str, dict[str, tuple[list[int], list[tuple[int, int, frozenset]]]]] = {}
        for k, norm in norms:
            every = set(norm.split(" "))
            least, words = max(2, len(every) - 1), sorted((w for w in every if LONG_WORD.fullmatch(w)), key=lambda w: (-len(w), w))
            for pair in combinations(words[: 2 + len(words) - least], 2) if len(words) >= least else ():
                sure, asked = self.partners.setdefault(min(pair), {}).setdefault(max(pair), ([], []))
                if least == 2:
                    sure.append(k)
                else:
                    asked.append((k, least, frozenset(words)))

    def first_lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(heading, line) of the first line under 100 characters that holds each heading."""
        headings, at, seen = [], [], set()
        for pos, line in enumerate(lines):
            if 0 < len(line) < 100:
                words = set((PLAIN_LONG_WORD if line.isascii() else LONG_WORD).findall(line))
                for a in words & self.partners.keys():
                    of = self.partners[a]
                    for b in of.keys() & words:
                        sure, asked = of[b]
                        held = [k for k, least, all_of in asked if len(all_of & words) >= least]
                        if (a, b) not in seen:
                            seen.add((a, b))
                            held += sure
                        headings += held
                        at += [pos] * len(held)
        found, first = np.unique(np.array(headings, dtype=np.int64), return_index=True)
        return found, np.array(at, dtype=np.int64)[first]


def section_sizes(lines: list[str], at: np.ndarray, longest: int) -> np.ndarray:
    """Words of the lines after each of ``at``, to the next short one after an empty one or ``longest - 1`` of them."""
    before = np.cumsum([0, *(len(x.encode().split()) for x in lines)])
    breaks = np.array([i for i in range(1, len(lines)) if not lines[i - 1] and 6 <= len(lines[i]) <= 79] + [len(lines)])
    stop = np.minimum(breaks[np.minimum(np.searchsorted(breaks, at + 2, side="right"), len(breaks) - 1)], at + longest)
    return before[np.maximum(stop, at + 1)] - before[at + 1]


def find_sections(texts: DataFrame, headings: DataFrame, longest: int = 50, whole_table: int = 200_000) -> DataFrame:
    """``(topic_id, src, doc_id, norm, words)``: the size of the section under each heading that a text of its topic holds.

    Of ``texts(topic_id, src, doc_id, text)`` and ``headings(topic_id, norm)``. A heading stands in the first line under 100 characters
    that shares all its words but one with it, two at least, words of three letters or more; its section are the lines after that, to the next
    short one (6 to 79 characters) after an empty one, not within the first two, or ``longest - 1`` of them.

    At most ``whole_table`` headings are broadcast and sought in the text's own row, which nothing leaves but what is found. More of them meet
    the lines on pairs of words by an equal-key join; a text itself stays in its row, only numbers of words of its lines leave it.
    """
    known = headings.filter("topic_id IS NOT NULL").select("topic_id", "norm").distinct()
    texts = texts.filter("topic_id IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("topic_id", "src", "doc_id", F.lower("text").alias("text"))
    listed = [(r.topic_id, r.norm) for r in known.limit(whole_table + 1).collect()]
    if len(listed) > whole_table:
        return joined_sections(texts, known, longest)
    by_topic: dict = {}
    for k, (topic, norm) in enumerate(listed):
        by_topic.setdefault(topic, []).append((k, norm))
    sought = texts.sparkSession.sparkContext.broadcast(({topic: HeadingIndex(norms) for topic, norms in by_topic.items()}, pa.array([norm for _, norm in listed], pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, norms = sought.value
        for batch in batches:
            topics, rows, found, words, n = batch.column(0).to_pylist(), [], [], [], 0
            for k, topic in enumerate(topics):
                if topic in indexes:
                    lines = [x.strip(" ") for x in batch.column(3)[k].as_py().split("\n")]
                    of, at = indexes[topic].first_lines(lines)
                    if len(of):
                        rows.append(np.full(len(of), k))
                        found.append(of)
                        words.append(section_sizes(lines, at, longest))
                        n += len(of)
                if rows and (n >= 50_000 or k + 1 == len(topics)):
                    row = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in range(3)], norms.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(words).astype(np.int64))], names=["topic_id", "src", "doc_id", "norm", "words"])
                    rows, found, words, n = [], [], [], 0

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:3])
    return texts.mapInArrow(run, f"{kinds}, norm string, words bigint")


def joined_sections(texts: DataFrame, headings: DataFrame, longest: int) -> DataFrame:
    """``find_sections`` of lower-case texts by a join on pairs of words; of ``s`` shared words a line and a heading share ``s * (s - 1) / 2``."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    numbers = F.transform("lines", lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    breaks = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.length(F.get("lines", i)).between(6, 79) & (i > 0) & (F.get("lines", i - 1) == ""))
    rows = texts.withColumn("lines", lines)
    shapes = rows.select("topic_id", "src", "doc_id", numbers.alias("numbers"), breaks.alias("breaks"))
    short = rows.select("topic_id", "doc_id", F.posexplode("lines").alias("pos", "line")).filter((F.length("line") < 100) & (F.col("line") != ""))
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("line", F.lit(r"(\p{L}{3,})"), F.lit(1))))
    held = short.select("topic_id", "doc_id", "pos", words.alias("w")).select("topic_id", "doc_id", "pos", F.explode(word_pairs(F.col("w"))).alias("pair"))
    asked = headings.select("topic_id", "norm", F.array_distinct(F.split("norm", " ")).alias("all"))
    asked = asked.select("topic_id", "norm", F.greatest(F.lit(2), F.size("all") - 1).alias("least"), F.array_sort(F.filter("all", lambda w: w.rlike(r"^\p{L}{3,}$"))).alias("w")).filter("size(w) >= least")
    asked = asked.select("topic_id", "norm", "least", F.explode(word_pairs(F.col("w"))).alias("pair"))
    shared = held.join(asked, ["topic_id", "pair"]).groupBy("topic_id", "doc_id", "pos", "norm", "least").agg(F.count(F.lit(1)).alias("shared"))
    found = shared.filter("2 * shared >= least * (least - 1)").groupBy("topic_id", "doc_id", "norm").agg(F.min("pos").alias("at"))
    placed = found.join(shapes, ["topic_id", "doc_id"])
    stop = F.least(F.coalesce(F.array_min(F.filter("breaks", lambda i: i > F.col("at") + 2)), F.size("numbers")), F.size("numbers"), F.col("at") + longest)
    words = F.aggregate(F.slice("numbers", F.col("at") + 2, F.greatest(stop - F.col("at") - 1, F.lit(0))), F.lit(0), lambda a, x: a + x)
    return placed.select("topic_id", "src", "doc_id", "norm", words.cast("long").alias("words"))


def gap_depth(headings: DataFrame, texts: DataFrame, least: int = 3, short: int = 120, high: int = 80) -> DataFrame:
    """``(topic_id, heading, sources, sections, mean_words, priority)``: headings of ``least`` sources or more whose sections in ``texts`` are short on average.

    Of ``headings(topic_id, src, heading)``; sections of ten words or fewer do not count.
    """
    rows = headings.withColumn("norm", heading_norm(F.col("heading"))).filter("norm <> ''").groupBy("topic_id", "norm").agg(F.min("heading").alias("heading"), F.countDistinct("src").alias("sources"))
    rows = materialise(rows.filter(F.col("sources") >= least))
    sizes = find_sections(texts, rows).filter("words > 10").groupBy("topic_id", "norm").agg(F.count(F.lit(1)).alias("sections"), F.avg("words").alias("mean"))
    rows = rows.join(sizes, ["topic_id", "norm"]).filter(F.col("mean") < short)
    return rows.select("topic_id", "heading", "sources", "sections", F.round("mean", 4).alias("mean_words"), F.when(F.col("mean") <= high, "high").otherwise("medium").alias("priority"))


def split_questions(questions: DataFrame, gaps: DataFrame, stop: list[str]) -> DataFrame:
    """``(topic_id, id, kind, rank, faq)`` of ``questions(topic_id, id, question, answer)``: open ones (a gap, or an answer under 20 characters, eight) and standard ones (ten).

    The six first open ones are for the frequent questions.
    """
    open_ = gaps.select("topic_id", "id").distinct().withColumn("gap", F.lit(True))
    rows = questions.filter(F.size(content_words(F.col("question"), stop)) > 0).join(open_, ["topic_id", "id"], "left")
    kind = F.when(F.col("gap") | (F.length(F.coalesce("answer", F.lit(""))) < 20), "open").otherwise("standard")
    rows = rows.withColumn("kind", kind).select(F.struct("topic_id", "kind").alias("topic_id"), "id")
    rows = ranked(rows, 10, F.asc("id")).select("topic_id.topic_id", "id", "topic_id.kind", "rank").filter("kind = 'standard' OR rank <= 8")
    return rows.withColumn("faq", (F.col("kind") == "open") & (F.col("rank") <= 6))
