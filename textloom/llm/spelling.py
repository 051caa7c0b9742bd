"""Operator 11: groups of spelling variants by a frontier that walks a trie relationally.

Words are counted over all texts. Each word and its reversal walk a trie whose edges are a distributed table, built level by
level from the words that are still under way: an edge is the longest string that all words of a node with one first
letter share, so a level ends where words part or a word ends. States ``(word, place, node, edits)`` join the level's edges on the
node. Without an edit a state follows its own edge, replaces its next letter by that of a later sibling edge, or deletes it; with one it
only follows. Every pair is found although few edges are tried: one edit lies in the second half of the word or of its
reversal, an insertion into one word is a deletion from the other one, a replacement is tried from the smaller letter
alone, and of a run of equal letters the last is deleted, which is always at a node. Terminal states of one edit that
end a word are neighbours; their words are looked up among all words, so hashed node names cannot add any.

Levels are as many as branches on the deepest path, whatever the length of words. A hot node is a skewed equal-key join
against at most one edge a letter, which adaptive execution splits.

Defined results: a null text has no words; a null id counts as empty in the checksum; repeated rows count each; words of equal
counts are ordered by code points; an empty table or one without frequent words gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: One in so many occurrences, by checksum, loses a letter.
HARM = 199
#: Length of the longest common prefix of ``lo`` and ``hi`` by halving steps.
SHARED = """aggregate(sequence(int(floor(log2(length(lo)))), 0, -1), 0, (acc, k) ->
    if(acc + shiftleft(1, k) <= least(length(lo), length(hi)) AND left(lo, acc + shiftleft(1, k)) = left(hi, acc + shiftleft(1, k)), acc + shiftleft(1, k), acc))"""


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, memory: int = 300_000) -> DataFrame:
    """``(word, n)`` over all texts; a task adds up before the shuffle and keeps ``memory`` words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, text = doc.as_py(), text.as_py()
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % HARM == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) > memory:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["word", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["word", "n"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def level_edges(state: DataFrame) -> DataFrame:
    """``(at, first, label, below, child, stops)`` of the nodes that words without an edit have reached."""
    rest = state.filter("edits = 0").selectExpr("node AS at", "substring(text, place + 1, 1) AS first", "substring(text, place + 1) AS rest")
    grown = rest.groupBy("at", "first").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.count(F.lit(1)).alias("below"))
    named = grown.selectExpr("at", "first", "lo", "below", f"if(below = 1, lo, left(lo, {SHARED})) AS label")
    return named.selectExpr("at", "first", "label", "below", "xxhash64(at, label) AS child", "label = lo AS stops")


def near_words(words: DataFrame, in_task: int = 100_000) -> DataFrame:
    """``(word, near)`` in both directions for all ``words`` (distinct, column ``word``) one inserted, deleted or replaced code point apart.

    A level is written in as many partitions as its states need, ``in_task`` for each, so late levels of few states are few tasks.
    """
    ways = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("text")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("text"))))
    n_states = 2 * words.count()
    state = words.filter("word <> ''").select(ways.alias("w")).selectExpr("w.side", "w.text AS word", "w.text", "0 AS place", "bigint(w.side) AS node", "false AS stops", "0 AS edits")
    found = []
    while n_states:
        parts = -(-n_states // in_task)
        edges = materialise(level_edges(state).coalesce(parts))
        if edges.isEmpty():
            break
        late = "edits = 0 AND place >= length(word) div 2"
        cut = state.filter(f"{late} AND substring(word, place + 1, 1) <> substring(word, place + 2, 1)")
        cut = cut.selectExpr("side", "word", "left(word, place) || substring(word, place + 2) AS text", "place", "node", "stops", "1 AS edits")
        ended = cut.filter("place = length(text) AND stops")
        under_way = state.unionByName(cut.filter("place < length(text)"))
        follows = "substring(text, place + 1, length(label)) = label"
        replaces = f"{late} AND first > substring(text, place + 1, 1) AND substring(text, place + 2, length(label) - 1) = substring(label, 2)"
        met = under_way.withColumnRenamed("stops", "stopped").join(edges, F.expr(f"node = at AND (({follows}) OR ({replaces}))"))
        moved = met.selectExpr(
            "side", "word",
            "if(first = substring(text, place + 1, 1), text, left(text, place) || first || substring(text, place + 2)) AS text",
            "place + length(label) AS place", "child AS node", "stops",
            "if(first = substring(text, place + 1, 1), edits, 1) AS edits", "below",
        )
        moved = moved.filter("(place < length(text) AND below > 1) OR (edits = 1 AND place = length(text) AND stops)").drop("below")
        state = materialise(moved.unionByName(ended).coalesce(2 * parts))
        found.append(state.filter("place = length(text)").select("side", "word", "text"))
        state = state.filter("place < length(text)")
        n_states = state.count()
    if not found:
        return words.selectExpr("word", "word AS near").limit(0)
    pairs = reduce(DataFrame.unionByName, found).selectExpr("if(side = 0, word, reverse(word)) AS a", "if(side = 0, text, reverse(text)) AS b")
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.word", "p.near").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last word that forms lead to from each of ``(word, form)``, in as many rounds as the logarithm of the longest chain."""
    links = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        up = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        links = materialise(links.join(up, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = links.filter("moved").isEmpty()
        links = links.drop("moved")
        if moved:
            return links


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5, times: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for all words of ``least`` letters or more that occur ``often`` times or more.

    ``form`` is the most frequent near word, if it occurs ``times`` times as often at least.
    """
    words = materialise(word_counts(docs, id_col, text_col, least).filter(F.col("n") >= often))
    met = near_words(words.select("word")).join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    leads = -F.col("best.less") >= times * F.col("n")
    known = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")))
    last = roots(known.filter("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
