"""Entities from a gazetteer instead of a tagging model (family F)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.operators.grams import ranked

WORD = regex.compile(r"\p{L}+")
#: The same in a text of ASCII alone, found faster.
PLAIN_WORD = re.compile(r"[A-Za-z]+")
#: Where a sentence and where a paragraph ends.
SENTENCE = re.compile(r"[.!?]+[ \t\n\f\r]+")
PARAGRAPH = re.compile(r"\n[ \t\n\f\r]*\n")
#: What ``match_entities`` adds to the keys of a text.
PLACES = {"pos": pa.int64(), "n_words": pa.int64(), "start_char": pa.int64(), "end_char": pa.int64(), "sentence": pa.int64(), "paragraph": pa.int64(), "phrase": pa.string(), "etype": pa.string(), "surface": pa.string(), "context": pa.string(), "sentence_text": pa.string(), "paragraph_chars": pa.int64()}
_DDL = ", ".join(f"{c} {'string' if k == pa.string() else 'bigint'}" for c, k in PLACES.items())


def words_in(text: str) -> list[str]:
    """The words of a text in lower case."""
    return PLAIN_WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


class PhraseAutomaton:
    """All phrases of a gazetteer in one walk over a text's words: a trie of words with the links of Aho and Corasick."""

    def __init__(self, phrases: list[tuple[str, str]]):
        self.go: list[dict[str, int]] = [{}]
        self.out: list[list[tuple[int, str, str]]] = [[]]
        for phrase, etype in phrases:
            at, words = 0, WORD.findall(phrase.lower())
            for w in words:
                if w not in self.go[at]:
                    self.go[at][w] = len(self.go)
                    self.go.append({})
                    self.out.append([])
                at = self.go[at][w]
            if words:
                self.out[at].append((len(words), phrase, etype))
        self.fail = [0] * len(self.go)
        waiting = deque(self.go[0].values())
        while waiting:
            at = waiting.popleft()
            for w, child in self.go[at].items():
                back = self.fail[at]
                while back and w not in self.go[back]:
                    back = self.fail[back]
                self.fail[child] = self.go[back].get(w, 0) if self.go[back].get(w, 0) != child else 0
                self.out[child] = self.out[child] + self.out[self.fail[child]]
                waiting.append(child)
        self.known = {w for children in self.go for w in children}

    def find(self, words: list[str]) -> list[tuple[int, int, str, str]]:
        """(first word, words, phrase, kind) of every place."""
        at, found, last, known = 0, [], -1, self.known
        for i in [i for i, w in enumerate(words) if w in known]:  # any other word leads back to the root
            at, last, w = at if i == last + 1 else 0, i, words[i]
            while at and w not in self.go[at]:
                at = self.fail[at]
            at = self.go[at].get(w, 0)
            found += [(i - n + 1, n, phrase, etype) for n, phrase, etype in self.out[at]]
        return found


def widest(found: list[tuple]) -> list[tuple]:
    """Places (first word, words, ...) that no longer one holds, in order."""
    kept, reach = [], -1
    for place in sorted(found, key=lambda f: (f[0], -f[1], *f[2:])):
        end = place[0] + place[1]
        if end > reach or (kept and kept[-1][:2] == place[:2]):
            kept.append(place)
        reach = max(reach, end)
    return kept


def _described(text: str, found: list[tuple], around: int) -> Iterator[tuple]:
    """The columns of ``PLACES`` for places in a text; without ``around`` no context and no sentence."""
    words = [m.span() for m in (PLAIN_WORD if text.isascii() else WORD).finditer(text)]
    units = []
    for pattern in (SENTENCE, PARAGRAPH):
        marks = [m.span() for m in pattern.finditer(text)]
        units.append(([0, *(b for _, b in marks)], [*(a for a, _ in marks), len(text)]))
    for first, n, phrase, etype in found:
        start, end = words[first][0], words[first + n - 1][1]
        (sentences, stops), (paragraphs, rests) = units
        s, p = bisect_right(sentences, start) - 1, bisect_right(paragraphs, start) - 1
        context = text[max(0, start - around) : end + around] if around else None
        yield first, n, start, end, s, p, phrase, etype, text[start:end], context, text[sentences[s] : stops[s]].strip(" ")[:200] if around else None, rests[p] - paragraphs[p]


def match_entities(sources: DataFrame, gazetteer: DataFrame, around: int = 0, limit: int | None = None, least_chars: int = 100, least: int = 2, most: int = 100, whole_table: int = 200_000, placed: bool = True) -> DataFrame:
    """Each place where a phrase of ``gazetteer(phrase, etype)`` stands in ``sources(topic_id, src_idx, doc_id, content)``.

    ``(topic_id, src_idx, doc_id, pos, n_words, start_char, end_char, sentence, paragraph, phrase, etype, surface, context,
    sentence_text, paragraph_chars)``: ``pos`` counts words, ``start_char`` and ``end_char`` characters from 0, the others sentences and paragraphs; context
    (``around`` characters on either side) and sentence are null without ``around``. Words are letter runs in any
    case; of places within each other the longest stays, places that only overlap stay both. Texts under ``least_chars`` and phrases outside
    ``least`` to ``most`` characters are left out; ``limit`` cuts texts.

    A gazetteer of at most ``whole_table`` phrases is an automaton that walks each text once; of a larger one only the lengths are
    gathered, and runs of those lengths meet the phrases by an equal-key join. Unless ``placed``, only ``pos, n_words, phrase, etype`` are told, for those who count.
    """
    phrases = gazetteer.filter(F.length("phrase").between(least, most)).select("phrase", "etype").distinct()
    text = F.col("content") if limit is None else F.substring("content", 1, limit)
    rows = sources.filter(F.length("content") >= least_chars).select("topic_id", "src_idx", "doc_id", text.alias("content"))
    listed = [(r.phrase, r.etype) for r in phrases.limit(whole_table + 1).collect()]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    if len(listed) <= whole_table:
        automaton = PhraseAutomaton(sorted(listed, key=repr))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _places(batches, lambda words: widest(automaton.find(words)), around, placed)

        return rows.mapInArrow(run, f"{schema}, {_DDL}")
    key = F.array_join(F.regexp_extract_all(F.lower("phrase"), F.lit(r"(\p{L}+)"), F.lit(1)), " ")
    keyed = phrases.select(key.alias("key"), "phrase", "etype").filter("key <> ''")
    lengths = sorted(r.n for r in keyed.select(F.size(F.split("key", " ")).alias("n")).distinct().collect())

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _places(batches, lambda words: [(i, n, " ".join(words[i : i + n]), None) for n in lengths for i in range(len(words) - n + 1)], around, placed)

    met = rows.mapInArrow(runs, f"{schema}, {_DDL}").withColumnRenamed("phrase", "key").drop("etype").join(keyed.select("key").distinct(), "key")
    before = Window.partitionBy("topic_id", "src_idx", "doc_id").orderBy("pos", F.desc("n_words")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("n_words")
    kept = met.withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(-1))).filter(F.col("reach") < end)
    return kept.join(keyed, "key").select("topic_id", "src_idx", "doc_id", *PLACES)


def _places(batches: Iterator[pa.RecordBatch], found_in: Callable[[list[str]], list[tuple]], around: int, placed: bool = True, size: int = 4_000) -> Iterator[pa.RecordBatch]:
    """Rows of ``PLACES`` for what ``found_in`` finds in the words of each text, ``size`` or a text's at a time."""
    for batch in batches:
        names = [*batch.schema.names[:3], *PLACES]

        def written(at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            keys = [batch.column(i).take(pa.array(at, type=pa.int64())) for i in range(3)]
            return pa.RecordBatch.from_arrays([*keys, *[pa.array(c, type=t) for c, t in zip(zip(*rows), PLACES.values())]], names=names)

        at, rows = [], []
        for k, content in enumerate(batch.column(3)):
            text = content.as_py()
            if found := found_in(words_in(text)):
                rows += _described(text, found, around) if placed else ((f, n, *[None] * 4, phrase, etype, *[None] * 4) for f, n, phrase, etype in found)
                at += [k] * (len(rows) - len(at))
            if len(rows) >= size:
                yield written(at, rows)
                at, rows = [], []
        if rows:
            yield written(at, rows)


def entity_stats(mentions: DataFrame, n_sources: DataFrame, priority: tuple = ("PERSON", "ORGANIZATION", "PRODUCT"), limit: int = 50) -> DataFrame:
    """``(topic_id, phrase, etype, freq, sources, importance, rank)``; counts are combined per source first."""
    per = mentions.groupBy("topic_id", "phrase", "etype", "src_idx").agg(F.count(F.lit(1)).alias("n"))
    rows = per.groupBy("topic_id", "phrase", "etype").agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("sources")).join(n_sources, "topic_id")
    first = F.when(F.col("etype").isin(*priority), 0.2).otherwise(0.0)
    value = F.lit(0.3) + first + F.least(F.lit(0.25), 0.08 * F.log(F.col("freq") + 1)) + 0.25 * F.col("sources") / F.col("n_sources")
    rows = rows.withColumn("importance", F.round(F.least(F.lit(1.0), value), 6)).drop("n_sources")
    order = Window.partitionBy("topic_id").orderBy(F.desc("importance"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def first_contexts(rows: DataFrame, keys: list[str], context: str, order: Column, n: int = 3) -> DataFrame:
    """``(keys, contexts)``: the first ``n`` different contexts of each key by ``order``.

    Equal contexts are combined before the shuffle, and the rank limit drops all but ``n`` of a key in each partition, so no list
    is longer than ``n`` however often a key occurs.
    """
    each = rows.filter(F.col(context).isNotNull()).groupBy(*keys, context).agg(F.min(order).alias("__at"))
    nearest = each.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__at", context))).filter(F.col("__rank") <= n)
    return nearest.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", F.col(context).alias("c")))), lambda x: x["c"]).alias("contexts"))


def entity_details(mentions: DataFrame, n: int = 3) -> DataFrame:
    """``(topic_id, phrase, etype, surface, freq_min, freq_median, freq_max, contexts)`` of mentions with contexts.

    The first way of writing by source and place, the range of the counts of sources with the floor of their median, and ``n`` contexts.
    """
    keys = ["topic_id", "phrase", "etype"]
    place = F.struct("src_idx", "doc_id", "start_char")
    per = mentions.groupBy(*keys, "src_idx").agg(F.count(F.lit(1)).alias("n"), F.min_by("surface", place).alias("surface"))
    ranges = per.groupBy(*keys).agg(F.min_by("surface", "src_idx").alias("surface"), F.min("n").alias("freq_min"), F.floor(F.percentile("n", F.lit(0.5))).alias("freq_median"), F.max("n").alias("freq_max"))
    return ranges.join(first_contexts(mentions, keys, "context", place, n), keys, "left")


def cooccurrence(mentions: DataFrame, entities: DataFrame, n_sources: DataFrame, least_chars: int = 50, limit: int = 20) -> DataFrame:
    """``(topic_id, a, b, n, paragraphs, sources, strength, context, rank)``: unordered pairs of ``entities(topic_id, phrase)`` in one sentence or paragraph.

    Of ``mentions`` with sentences; paragraphs under ``least_chars`` are left out. A pair needs two places in a topic of over four sources, else one. Entities
    come from a ranked list, so a sentence's pairs are bounded by that list, whatever its length; no sentence meets another one.
    """
    kept = mentions.join(entities.select("topic_id", "phrase").distinct(), ["topic_id", "phrase"])
    text = ["topic_id", "src_idx", "doc_id"]

    near = F.col("kind") == 0
    unit = lambda kind, of, said: F.struct(F.lit(kind).alias("kind"), F.col(of).cast("long").alias("unit"), said.cast("string").alias("sentence_text"))
    units = F.array(unit(0, "sentence", F.col("sentence_text")), unit(1, "paragraph", F.lit(None)))
    placed = kept.select(*text, "phrase", "paragraph_chars", F.explode(units).alias("u")).select(*text, "phrase", "paragraph_chars", "u.*").filter(near | (F.col("paragraph_chars") >= least_chars))
    held = placed.groupBy(*text, "kind", "unit").agg(F.array_sort(F.collect_set("phrase")).alias("f"), F.min("sentence_text").alias("sentence_text")).filter("size(f) > 1")
    each = F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    per = held.withColumn("p", F.explode(each)).groupBy("topic_id", "p.a", "p.b", "src_idx")  # mentions are read once for both units
    per = per.agg(F.sum(near.cast("long")).alias("s"), F.sum((~near).cast("long")).alias("w"), F.min(F.when(near, F.struct("doc_id", "unit", "sentence_text"))).alias("first"))
    first = F.min(F.when(F.col("s") > 0, F.struct("src_idx", "first")))
    rows = per.groupBy("topic_id", "a", "b").agg(F.sum("s").alias("n"), F.sum(((F.col("s") > 0) & F.col("src_idx").isNotNull()).cast("long")).alias("sources"), first["first"]["sentence_text"].alias("context"), F.sum("w").alias("paragraphs"))
    rows = rows.join(n_sources.select("topic_id", "n_sources"), "topic_id")
    rows = rows.filter(F.col("n") + F.col("paragraphs") >= F.when(F.col("n_sources") <= 4, 1).otherwise(2))
    spread = F.when(F.col("sources") >= 2, 1 + 0.2 * F.col("sources")).otherwise(1.0)
    rows = rows.withColumn("strength", F.round(F.least(F.lit(1.0), (3 * F.col("n") + F.col("paragraphs")) * spread / 50), 6)).drop("n_sources")
    return ranked(rows, limit, F.desc("strength"), "a", "b")
