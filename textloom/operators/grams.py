"""Tokens, n-grams and their statistics (family D)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.operators.lineage import materialise


def tokens(sources: DataFrame, limit: int | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """``(topic_id, src_idx, doc_id, words)``: lower-case letter runs, of the first ``limit`` characters if it is given, in order.

    With ``lexicon(surface, lemma)`` one row per word: ``pos, surface, lemma``; unlisted words are their own lemma.
    """
    if lexicon is None:
        text = F.col("content") if limit is None else F.substring("content", 1, limit)
        return sources.select("topic_id", "src_idx", "doc_id", F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)).alias("words"))
    rows = tokens(sources, limit).select("topic_id", "src_idx", "doc_id", F.posexplode("words").alias("pos", "surface"))
    return rows.join(lexicon, "surface", "left").withColumn("lemma", F.coalesce("lemma", "surface"))


def gram_runs(toks: DataFrame) -> DataFrame:
    """``(topic_id, src_idx, run)``: from each word that another follows, it and the next three, fewer at the end.

    Every gram of two to four words is the beginning of one run. Grams cross sentence marks but not documents. Each word meets its
    followers as columns of one row, so runs are joined in generated code, not in array functions.
    """
    follow = [F.slice("words", k + 1, 1 << 30).alias(f"w{k}") for k in range(4)]
    rows = toks.select("topic_id", "src_idx", F.explode(F.arrays_zip(*follow)).alias("w")).select("topic_id", "src_idx", "w.*")
    return rows.filter("w1 IS NOT NULL").select("topic_id", "src_idx", F.concat_ws(" ", "w0", "w1", "w2", "w3").alias("run"))


def lemma_grams(toks: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """``(topic_id, src_idx, gram, surface)`` of the rows of ``tokens`` with a lexicon: grams of lemmas and how they are written."""
    order = Window.partitionBy("topic_id", "src_idx", "doc_id").orderBy("pos")
    lead = lambda c, n: F.concat_ws(" ", *[F.lead(c, k).over(order) for k in range(n)])
    rows = toks.withColumns({f"g{n}": F.when(F.lead("lemma", n - 1).over(order).isNotNull(), F.struct(lead("lemma", n).alias("gram"), lead("surface", n).alias("surface"))) for n in range(low, high + 1)})
    return rows.select("topic_id", "src_idx", F.explode(F.array_compact(F.array(*[f"g{n}" for n in range(low, high + 1)]))).alias("g")).select("topic_id", "src_idx", "g.*")


def gram_displays(grams: DataFrame) -> DataFrame:
    """``(topic_id, gram, display, freq)`` of ``grams(topic_id, gram, surface)``: the most frequent way of writing, of equals the first in order."""
    per = grams.groupBy("topic_id", "gram", "surface").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("topic_id", "gram").agg(F.min_by("surface", F.struct(-F.col("n"), "surface")).alias("display"), F.sum("n").alias("freq"))


def text_gram_displays(toks: DataFrame, chars: int = 0) -> DataFrame:
    """``gram_displays`` of the grams of two words of ``lemma_words``, which are counted where they are dealt to; ``chars`` as in ``text_gram_stats``.

    A word that is not its own lemma travels behind it.
    """
    marked = F.zip_with("words", "surfaces", lambda w, s: F.when(w == s, w).otherwise(F.concat(w, F.lit("\t"), s)))
    dealt, forms, topic = _dealt(toks.select("topic_id", F.lit("").alias("src_idx"), "doc_id", marked.alias("words")), chars, 2)
    return dealt.mapInArrow(partial(_displayed, forms=forms, topic=topic), f"topic_id {toks.schema['topic_id'].dataType.simpleString()}, gram string, display string, freq bigint")


def _displayed(batches: Iterator[pa.RecordBatch], forms: dict[str, str], topic: pa.DataType) -> Iterator[pa.RecordBatch]:
    packs = (pa.Table.from_batches([some]) for batch in batches for some in _opened(batch, topic))
    held = [_together(x.drop(["src_idx"])) for x in packs]
    if not held:
        return
    runs = _together(pa.concat_tables(held))
    words = pc.split_pattern(pa.concat_arrays(runs.column("run").chunks), " ")
    vocabulary, code = _coded(words.flatten())
    whole = [(forms.get(w) or w.removeprefix(OTHER)).partition("\t") for w in vocabulary.to_pylist()]
    said = lambda of: pc.binary_join_element_wise(*[pa.array(of, pa.string()).take(pa.array(code[k::2])) for k in (0, 1)], " ")
    table = pa.table({"topic_id": runs.column("topic_id"), "gram": said([w[0] for w in whole]), "surface": said([w[2] or w[0] for w in whole]), "n": runs.column("n")})
    table = table.sort_by([("n", "descending"), ("surface", "ascending")])
    best = table.group_by(["topic_id", "gram"], use_threads=False).aggregate([("surface", "first"), ("n", "sum")])
    yield from best.select(["topic_id", "gram", "surface_first", "n_sum"]).rename_columns(["topic_id", "gram", "display", "freq"]).to_batches(max_chunksize=50_000)


#: Characters of text whose runs one task counts.
COUNTED_CHARS = 6_000_000
#: Runs that a task holds before it takes equal ones together.
HELD_RUNS = 1_000_000
#: Words whose runs a task packs at once; packing takes some hundred bytes a word.
PACKED_WORDS = 400_000
#: Words whose packs are compressed together; they are held in some ten bytes a word.
SENT_WORDS = 2_000_000
#: Frequent words that are written short where runs are shuffled, and characters of text in which they are looked for.
SHORT_WORDS, SEEN_CHARS = 30_000, 5_000_000
#: What a short form begins with, no letter and so no word's own beginning, and what follows.
FIRST, NEXT = "0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~", "".join(map(chr, range(33, 127)))
#: What a word that no letter begins is marked with, as it may look like a short form.
OTHER = "\x01"


def short_forms(toks: DataFrame, chars: int = 0) -> dict[str, str]:
    """A form of one to three characters for each of the frequent words of ``tokens``, the shortest for the most frequent.

    They are looked for in as many texts as hold some ``SEEN_CHARS`` of all ``chars``. Forms only write runs shorter while they are shuffled:
    other words stay as they are, and the counts are the same whatever words have one.
    """
    every = -(-chars // SEEN_CHARS)
    seen = toks if every <= 1 else toks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = seen.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    words = [r["word"] for r in counts.orderBy(F.desc("n"), F.asc("word")).limit(SHORT_WORDS).collect()]
    return dict(zip(words, (a + b + c for c in ("", *NEXT) for b in (("", *NEXT) if not c else NEXT) for a in FIRST)))


def packed_runs(toks: DataFrame, parts: int, forms: dict[str, str], longest: int = 4) -> DataFrame:
    """``(part, runs)``: the runs of ``gram_runs`` under the task of their topic and first two words, compressed; ``_opened`` reads them.

    Each task takes the equal runs of a source together, ``n`` uses of each, writes frequent words in their short ``forms`` and compresses what
    goes to one task as one, so that few and short rows are shuffled. Of a word with a tab only what stands before it decides on the task.
    ``longest`` is two or four words.
    """
    rows = toks.select("topic_id", F.col("src_idx").cast("string").alias("src_idx"), "words")
    return rows.mapInArrow(partial(_packed, parts=parts, forms=forms, longest=longest), "part int, runs binary")


def _packed(batches: Iterator[pa.RecordBatch], parts: int, forms: dict[str, str], longest: int) -> Iterator[pa.RecordBatch]:
    held, n, ready, words = [], 0, defaultdict(list), 0
    for batch in batches:
        lengths, at = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(), 0
        for end in [*np.flatnonzero(np.diff((n + np.cumsum(lengths)) // PACKED_WORDS)) + 1, len(lengths)]:
            held.append(batch.slice(at, end - at))
            n, at = n + int(lengths[at:end].sum()), end
            if n >= PACKED_WORDS:
                for part, pack in _pack(pa.Table.from_batches(held), parts, forms, longest):
                    ready[part].append(pack)
                held, n, words = [], 0, words + n
                if words >= SENT_WORDS:
                    yield _sent(ready)
                    ready, words = defaultdict(list), 0
    for part, pack in _pack(pa.Table.from_batches(held), parts, forms, longest) if n else ():
        ready[part].append(pack)
    if ready:
        yield _sent(ready)


def _sent(packs: dict[int, list[bytes]]) -> pa.RecordBatch:
    """The packs of each task as one row."""
    runs = [pa.compress(b"".join(some), "zstd", asbytes=True) for some in packs.values()]
    return pa.RecordBatch.from_pydict({"part": pa.array(list(packs), pa.int32()), "runs": pa.array(runs, pa.binary())})


def _pack(rows: pa.Table, parts: int, forms: dict[str, str], longest: int) -> Iterator[tuple[int, bytes]]:
    topics, topic = _coded(rows.column(0))
    sources, source = _coded(rows.column(1))
    lists = pa.concat_arrays(rows.column(2).chunks)
    vocabulary, code = _coded(lists.flatten())
    words = vocabulary.to_pylist()
    lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy()
    text, end = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.cumsum(lengths), lengths)
    at = np.flatnonzero(np.arange(len(code)) + 1 < end)
    if not len(at):
        return
    word = [np.where(at + k < end[at], code[np.minimum(at + k, len(code) - 1)], -1) for k in range(longest)]
    seed = np.array([crc32(str(x).encode()) for x in [*topics.to_pylist(), None]], dtype=np.uint64)
    hashed = np.array([crc32(w.partition("\t")[0].encode()) for w in words], dtype=np.uint64)
    mixed = (seed[topic[text[at]]] * np.uint64(31) + hashed[word[0]]) * np.uint64(0x9E3779B97F4A7C15) + hashed[word[1]]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    group = (part * (len(topics) + 1) + topic[text[at]] + 1) * (len(sources) + 1) + source[text[at]] + 1
    size = len(words) + 1
    keys = [group, *((a + 1) * size + b + 1 for a, b in zip(word[::2], word[1::2]))]
    order = np.lexsort(keys[::-1])
    fresh = np.flatnonzero(np.append(True, np.any([np.diff(k[order]) != 0 for k in keys], axis=0)))
    uses = np.diff(np.append(fresh, len(order)))
    rank = np.lexsort((uses, group[order[fresh]]))
    shown, uses = order[fresh[rank]], uses[rank]
    first = np.flatnonzero(np.append(True, (np.diff(group[shown]) != 0) | (np.diff(uses) != 0)))
    short = pa.array([forms.get(w) or (w if w[:1].isalpha() else OTHER + w) for w in words], pa.string())
    runs = pc.binary_join_element_wise(*[short.take(pa.array(w[shown], mask=w[shown] < 0)) for w in word], " ", null_handling="skip")
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(shown)), pa.int32()), runs), "\n")
    of = text[at[shown[first]]]
    columns = {"topic_id": topics.take(pa.array(topic[of], mask=topic[of] < 0)), "src_idx": sources.take(pa.array(source[of], mask=source[of] < 0)), "n": pa.array(uses[first], pa.int64()), "runs": lines}
    sets, to = pa.RecordBatch.from_pydict(columns), part[shown[first]]
    start = np.flatnonzero(np.append(True, np.diff(to) != 0))
    yield from ((int(to[a]), sets.slice(a, b - a).serialize().to_pybytes()) for a, b in zip(start, np.append(start[1:], len(to))))


def _dealt(toks: DataFrame, chars: int, longest: int = 4) -> tuple[DataFrame, dict[str, str], pa.DataType]:
    """``packed_runs`` in the tasks that count them, the words of the short forms and the type of topics in packs."""
    forms, parts = short_forms(toks, chars), max(-(-chars // COUNTED_CHARS), toks.sparkSession.sparkContext.defaultParallelism)
    topic = toks.select("topic_id").limit(0).toArrow().schema.field(0).type
    return packed_runs(toks, parts, forms, longest).repartitionById(parts, "part"), {short: word for word, short in forms.items()}, topic


def text_gram_stats(toks: DataFrame, chars: int = 0, single: bool = True) -> tuple[DataFrame, DataFrame]:
    """``gram_stats`` of the grams of two to four words of ``tokens``, and ``(topic_id, top)``, the most uses of a gram of a topic.

    Both read one shuffle of ``packed_runs``; ``chars``, the size of the texts, sets its number of tasks.
    """
    dealt, forms, topic = _dealt(toks.filter("topic_id IS NOT NULL"), chars)
    stats = dealt.mapInArrow(partial(_counted_packs, single=single, forms=forms, topic=topic), _stats_schema(toks))
    tops = dealt.mapInArrow(partial(_most_used, topic=topic), f"topic_id {toks.schema['topic_id'].dataType.simpleString()}, top bigint")
    return stats, tops.groupBy("topic_id").agg(F.max("top").alias("top"))


def _counted_packs(batches: Iterator[pa.RecordBatch], single: bool, forms: dict[str, str], topic: pa.DataType = pa.string()) -> Iterator[pa.RecordBatch]:
    return _counted((opened for batch in batches for opened in _opened(batch, topic)), single, forms)


def _opened(batch: pa.RecordBatch, topic: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The runs of packs, a row each."""
    for some in (pack for packs in batch.column("runs") for pack in _unpacked(packs, topic)):
        lines = pc.split_pattern(some.column("runs"), "\n")
        of = pc.list_parent_indices(lines)
        yield pa.RecordBatch.from_arrays([some.column("topic_id").take(of), some.column("src_idx").take(of), lines.flatten(), some.column("n").take(of)], ["topic_id", "src_idx", "run", "n"])


def _unpacked(packs: pa.BinaryScalar, topic: pa.DataType) -> Iterator[pa.RecordBatch]:
    """``(topic_id, src_idx, n, runs)`` of each pack, the runs of a source with ``n`` uses, one per line."""
    schema = pa.schema({"topic_id": topic, "src_idx": pa.string(), "n": pa.int64(), "runs": pa.string()})
    stream = pa.BufferReader(pa.CompressedInputStream(pa.BufferReader(packs.as_buffer()), "zstd").read_buffer())
    while stream.tell() < stream.size():
        yield pa.ipc.read_record_batch(pa.ipc.read_message(stream), schema)


def _most_used(batches: Iterator[pa.RecordBatch], topic: pa.DataType = pa.string()) -> Iterator[pa.RecordBatch]:
    """Per topic the most uses of a gram in the task: of two words, as no gram occurs more often than its first two."""
    held, rows, limit = [], 0, HELD_RUNS
    for opened in (some for batch in batches for some in _opened(batch, topic)):
        words = pc.split_pattern(opened.column("run"), " ", max_splits=2)
        pair = pc.binary_join_element_wise(pc.list_element(words, 0), pc.list_element(words, 1), " ")
        held.append(pa.table({"topic_id": opened.column("topic_id"), "pair": pair, "n": opened.column("n")}))
        rows += opened.num_rows
        if rows > limit:
            held = [_together(pa.concat_tables(held))]
            rows = held[0].num_rows
            limit = max(HELD_RUNS, 2 * rows)
    if rows:
        most = _together(pa.concat_tables(held)).group_by("topic_id", use_threads=False).aggregate([("n", "max")])
        yield from most.select(["topic_id", "n_max"]).rename_columns(["topic_id", "top"]).to_batches()


def _stats_schema(rows: DataFrame) -> str:
    counts = ", ".join(f"{c} bigint" for c in ("freq", "freq_total", "sources", "freq_min", "freq_median", "freq_max"))
    return f"topic_id {rows.schema['topic_id'].dataType.simpleString()}, gram string, in_signals boolean, {counts}"


def gram_stats(grams: DataFrame, chars: int = 0, single: bool = True) -> DataFrame:
    """Per topic and gram: uses in sources and in all, sources, presence in signals, and the least, floor median and largest count of a source.

    Of ``gram_runs``, or of ``grams(topic_id, src_idx, gram)`` each counted as a whole; search signals are the source null. Runs are dealt by
    topic and first two words and cut into the grams that begin them only there: each place of a text is shuffled once instead
    of once for every length and once more for the sums. ``chars``, the size of the texts, sets the number of tasks, so that
    each counts in little memory. Rows without topic are left out; unless ``single``, so are grams of one use in one source and none in signals.
    """
    name = "run" if "run" in grams.columns else "gram"
    rows = grams.filter(f"topic_id IS NOT NULL AND {name} IS NOT NULL").select("topic_id", F.col("src_idx").cast("string").alias("src_idx"), name)
    parts, keys = -(-chars // COUNTED_CHARS), ("topic_id", F.substring_index(name, " ", 2) if name == "run" else name)
    dealt = rows.repartition(parts, *keys) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(*keys)
    return dealt.mapInArrow(partial(_counted, single=single), _stats_schema(rows))


def _counted(batches: Iterator[pa.RecordBatch], single: bool, forms: dict[str, str] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``gram_stats`` of one task: a gram is the number of the gram one word shorter and of its last word, numbered again.

    Runs stand for ``n`` uses, one without that column; ``forms`` has the words of those that are written short.
    """
    held, rows, limit = [], 0, HELD_RUNS
    for batch in batches:
        some = pa.Table.from_batches([batch])
        held.append(some if "n" in some.column_names else some.append_column("n", pa.array(np.ones(batch.num_rows, dtype=np.int64))))
        rows += batch.num_rows
        if rows > limit:
            held = [_together(pa.concat_tables(held))]
            rows = held[0].num_rows
            limit = max(HELD_RUNS, 2 * rows)
    if not rows:
        return
    runs = pa.concat_tables(held)
    topics, topic = _coded(runs.column(0))
    sources, source = _coded(runs.column(1))
    uses, texts = runs.column("n").to_numpy(), pa.concat_arrays(runs.column(2).chunks)
    least = 2 if runs.column_names[2] == "run" else 1
    words = pc.split_pattern(texts, " ") if least == 2 else pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32)), texts)
    vocabulary, code = _coded(words.flatten())
    if forms is not None:
        vocabulary = pa.array([forms.get(w) or w.removeprefix(OTHER) for w in vocabulary.to_pylist()], pa.string())
    length = words.value_lengths().to_numpy()
    start, at, gram = np.cumsum(length) - length, np.arange(rows), topic
    for k in range(length.max()):
        ok = length[at] > k
        at, gram = at[ok], gram[ok]
        first, gram = np.unique(gram * len(vocabulary) + code[start[at] + k], return_index=True, return_inverse=True)[1:]
        if k + 1 >= least:
            cell, of = np.unique(gram * (len(sources) + 1) + source[at] + 1, return_inverse=True)
            n = np.bincount(of, weights=uses[at]).astype(np.int64)
            figures = _figures(cell // (len(sources) + 1), cell % (len(sources) + 1) == 0, n, len(first))
            told = (figures["freq_total"] > 1) | (figures["freq"] == 0) | single
            kept = np.flatnonzero(told)
            shown = at[first[kept]]
            joined = pc.binary_join_element_wise(*[vocabulary.take(pa.array(code[start[shown] + j])) for j in range(k + 1)], " ")
            columns = {"topic_id": topics.take(pa.array(topic[shown])), "gram": joined, **{c: x[kept] for c, x in figures.items()}}
            yield from pa.table(columns).to_batches(max_chunksize=50_000)
            at, gram = at[told[gram]], gram[told[gram]]  # no longer gram occurs more often


def _coded(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The different values and the number of each row's, -1 for null."""
    coded = (pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return coded.dictionary, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _together(runs: pa.Table) -> pa.Table:
    """Equal runs as one with the sum of their uses."""
    keys = [c for c in runs.column_names if c != "n"]
    return runs.group_by(keys, use_threads=False).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"])


def _figures(of: np.ndarray, signal: np.ndarray, n: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Per gram, of ``size``, the figures of its counts ``n`` by source; ``of`` is the gram's number and ``signal`` tells the counts in signals."""
    total, shown = np.bincount(of, weights=n, minlength=size).astype(np.int64), np.bincount(of[signal], minlength=size) > 0
    of, n = of[~signal], n[~signal]
    n, sources = np.append(n[np.lexsort((n, of))], 1), np.bincount(of, minlength=size)
    start, some, before = np.cumsum(sources) - sources, sources > 0, np.append(0, np.cumsum(n))
    place = lambda k: n[np.where(some, start + k, -1)]  # the last, 1, for grams of signals alone
    median = (place((sources - 1) // 2) + place(sources // 2)) // 2
    return {"in_signals": shown, "freq": before[start + sources] - before[start], "freq_total": total, "sources": sources, "freq_min": place(0), "freq_median": median, "freq_max": place(sources - 1)}


def lemma_words(toks: DataFrame, lemmas: dict[str, str]) -> DataFrame:
    """``tokens`` with the words' lemmas as ``words`` and the words themselves as ``surfaces``; a short lexicon, other words are their own lemma."""
    listed = F.create_map(*[F.lit(x) for pair in sorted(lemmas.items()) for x in pair])
    return toks.withColumnRenamed("words", "surfaces").withColumn("words", F.transform("surfaces", lambda w: F.coalesce(listed[w], w)))


def with_displays(ranked_grams: DataFrame, toks: DataFrame, small: bool = False) -> DataFrame:
    """Add ``display``, the most frequent way of writing, of equals the first in order, to a few ranked grams of lemmas.

    Of ``lemma_words``; only the places of ranked grams leave a text's row. ``small`` says that the topics are few, so that their ranked grams are broadcast.
    """
    ranked_grams = materialise(ranked_grams)  # read twice
    lists = ranked_grams.groupBy("topic_id").agg(F.collect_set("gram").alias("asked"))  # as many as the rank limit
    rows = toks.join(F.broadcast(lists) if small else lists, "topic_id").select("topic_id", "words", "surfaces", "asked")
    found = rows.mapInArrow(_written, f"topic_id {toks.schema['topic_id'].dataType.simpleString()}, gram string, surface string")
    return ranked_grams.join(gram_displays(found).drop("freq"), ["topic_id", "gram"], "left")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(topic_id, gram, surface)`` of the places of the grams ``asked`` in ``words``; only words that begin one of them are looked at."""
    for batch in batches:
        topics, topic = _coded(batch.column(0))
        lists, surfaces = batch.column(1), batch.column(2).flatten()
        vocabulary, code = _coded(lists.flatten())
        number = {w: k for k, w in enumerate(vocabulary.to_pylist())}
        lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy()
        of, end = np.repeat(topic, lengths), np.repeat(np.cumsum(lengths), lengths)
        for k, some in zip(*np.unique(topic, return_index=True)):
            grams = [(g, [number.get(w, -1) for w in g.split(" ")]) for g in batch.column(3)[int(some)].as_py()]
            grams = [(g, words) for g, words in grams if min(words) >= 0]
            begins = np.flatnonzero(np.isin(code, [words[0] for _, words in grams]) & (of == k))
            for first in {words[0] for _, words in grams}:
                near = begins[code[begins] == first]
                for g, words in grams:
                    if words[0] == first:
                        at = near[near + len(words) <= end[near]]
                        for j, w in enumerate(words[1:], 1):
                            at = at[code[at + j] == w]
                        if len(at):
                            said = pc.binary_join_element_wise(*[surfaces.take(pa.array(at + j)) for j in range(len(words))], " ")
                            yield from pa.table({"topic_id": topics.take(pa.array(np.full(len(at), k))), "gram": pa.array([g] * len(at), pa.string()), "surface": said}).to_batches()


def shares_keyword() -> Column:
    """True where a gram has a word of its topic's keyword, which is the first thing that ``filter_grams`` splits."""
    return F.arrays_overlap(F.split("gram", " "), F.col("own_words"))


def filter_grams(stats: DataFrame, topics: DataFrame, small: bool = False) -> DataFrame:
    """Drop rare grams, and boilerplate of one or of nearly all sources that shares no word with the keyword.

    Of ``topics(topic_id, n_sources, keyword)``; grams that only signals hold stay. ``small`` says that the caller has checked that ``topics`` can
    be broadcast; otherwise all grams are shuffled by their topic.
    """
    topics = topics.withColumns({"own_words": F.split(F.lower("keyword"), r"\s+"), "keyword": F.lower("keyword")})
    rows = stats.join(F.broadcast(topics) if small else topics, "topic_id")
    cover, mean = F.col("sources") / F.col("n_sources"), F.col("freq") / F.greatest("sources", F.lit(1))
    lone = (F.col("sources") <= 1) & (F.col("freq") >= 20)
    plate = (F.col("n_sources") >= 3) & (F.col("sources") >= 2) & (cover >= 0.8) & (mean <= 1.5)
    only = F.col("in_signals") & (F.col("sources") == 0)
    return rows.filter(((F.col("freq") >= 2) | only) & (~(lone | plate) | shares_keyword()))


def weight_grams(stats: DataFrame, topics: DataFrame, small: bool = False, tops: DataFrame | None = None) -> DataFrame:
    """Filter grams and weigh them by frequency and spread, more where they hold the keyword or stand in signals.

    The largest frequency of a topic comes from a small aggregation that is joined back, not from a window over the topic. It reads the other
    counts too, none of which is larger, so that both readings of ``stats`` share one shuffle. ``tops(topic_id, top)`` has it
    already.
    """
    if tops is None:
        stats = stats.filter(F.col("freq_total") >= F.col("freq"))  # of all; both readings ask for both columns
        lesser = [F.col(c).cast("long") for c in ("freq", "sources", "in_signals", "freq_min", "freq_max")]
        tops = stats.groupBy("topic_id").agg(F.max(F.greatest("freq_total", *lesser)).alias("top"))
    rows = filter_grams(stats, topics.join(tops, "topic_id"), small)
    cover, mean = F.col("sources") / F.col("n_sources"), F.col("freq") / F.greatest("sources", F.lit(1))
    faint = (F.col("n_sources") >= 3) & (F.col("sources") >= 2) & (cover >= 0.6) & (mean <= 1.0) & ~shares_keyword()
    weight = F.round(0.5 * F.col("freq") / F.col("top") + 0.5 * cover, 4) + F.when(F.contains("gram", "keyword"), 0.1).otherwise(0.0) + F.when(F.col("in_signals"), 0.08).otherwise(0.0)
    weight = F.least(F.lit(1.0), F.when(faint, weight * 0.2).otherwise(weight))
    return rows.withColumn("weight", F.round(weight, 6)).drop("top", "keyword", "own_words")


def ranked(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows of each topic in a total order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(*order))).filter(F.col("rank") <= n)


def numbered(rows: DataFrame, *order) -> DataFrame:
    """All rows with their place in their topic in a total order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(*order)))


def top_grams(weighted: DataFrame, n: int = 30) -> DataFrame:
    return ranked(weighted, n, F.desc("weight"), F.asc("gram"))


def extended_terms(weighted: DataFrame, top: DataFrame, limit: int = 15, n: int = 30) -> DataFrame:
    """Grams outside the top list, of at most ``n`` a topic, that a middling number of sources share.

    The first ``limit`` of them are among the first ``limit + n`` of all grams, so only these meet the top list.
    """
    some = weighted.filter(middling())
    order = F.desc("sources"), F.desc("weight"), F.asc("gram")
    first = ranked(some, limit + n, *order).drop("rank")
    return ranked(first.join(top.select("topic_id", "gram"), ["topic_id", "gram"], "left_anti"), limit, *order)


def middling() -> Column:
    """True where a gram stands in a middling number of its topic's sources."""
    return (F.col("n_sources") >= 3) & (F.col("sources") >= F.greatest(F.lit(2), F.floor(0.3 * F.col("n_sources")))) & (F.col("sources") <= F.floor(0.8 * F.col("n_sources")))


def listed_grams(weighted: DataFrame, limit: int = 15, n: int = 30) -> DataFrame:
    """The rows of ``weighted`` that ``top_grams`` and ``extended_terms`` read, found in one pass and written: both give the same of them.

    That is the first ``n`` of a topic by weight and the first ``limit + n`` middling ones.
    """
    kinds = F.explode(F.when(middling(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = weighted.withColumn("__list", kinds).withColumn("__sources", F.when(F.col("__list") == 1, F.col("sources")))
    order = Window.partitionBy("topic_id", "__list").orderBy(F.desc("__sources"), F.desc("weight"), F.asc("gram"))
    first = rows.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= limit + n)
    return materialise(first.select(*weighted.columns).distinct())


def repeated_trigrams(docs: DataFrame, stop: list[str], key: str = "doc_id", text: str = "text", least: int = 4, first: int = 10) -> DataFrame:
    """Of a text's ``first`` most frequent word trigrams, those that occur ``least`` times, are longer than 10 characters and more than stop words."""
    dealt = docs.select(key, F.col(text).alias("text")).repartition(key)  # texts travel once, their trigrams not at all
    words = dealt.select(key, F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("words")).filter(F.size("words") > 5)
    grams = words.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.array_join(F.slice("words", i, 3), " "))).alias("gram"))
    counts = grams.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)  # rarer ones come after these
    order = Window.partitionBy(key).orderBy(F.desc("n"), F.asc("gram"))
    return counts.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= first) & (F.length("gram") > 10) & F.exists(F.split("gram", " "), lambda w: ~w.isin(stop))).drop("rank")


def keyphrase_priority(weighted: DataFrame, reason: Column, n: int = 30) -> DataFrame:
    """The first ``n`` grams against which no ``reason`` speaks by class (1 for a weight of 0.5 or more, 2 of 0.3, else 3), then weight."""
    rows = weighted.filter((F.col("freq_max") > 0) & reason.isNull()).withColumn("priority", F.when(F.col("weight") >= 0.5, 1).when(F.col("weight") >= 0.3, 2).otherwise(3))
    return ranked(rows, n, F.asc("priority"), F.desc("weight"), F.asc("gram"))
