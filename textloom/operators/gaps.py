"""Gaps between questions and headings, plans, triplets, issues and page text (families A, B, E, G, H, I, L)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.operators import text as page_text
from textloom.operators.grams import ranked
from textloom.operators.headings import words_of
from textloom.operators.lineage import materialise
from textloom.operators.vectors import cosine, dot


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct sorted words of four letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{4,})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(stop))))


def word_pairs(words: Column) -> Column:
    return F.flatten(F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda b: F.concat_ws(" ", a, b))))


def without_heading(rows: DataFrame, headings: DataFrame, stop: list[str], key: str = "id") -> DataFrame:
    """Rows ``(topic_id, key, words)`` of two content words or more that share two of them with no heading of the topic.

    Two shared words are one shared pair, so pairs meet by an equal-key join; texts are never compared one by one.
    """
    pairs = headings.select("topic_id", F.explode(word_pairs(content_words(F.col("heading"), stop))).alias("pair")).distinct()
    rows = rows.filter(F.size("words") >= 2)
    covered = rows.select("topic_id", key, F.explode(word_pairs(F.col("words"))).alias("pair")).join(pairs, ["topic_id", "pair"], "left_semi").select("topic_id", key).distinct()
    return rows.join(covered, ["topic_id", key], "left_anti")


def gap_unanswered(questions: DataFrame, headings: DataFrame, tokens: DataFrame, stop: list[str]) -> DataFrame:
    """``(topic_id, id, share, priority)``: questions without a heading, of whose words less than 80 % stand in the topic's sources (60 %: high).

    ``questions(topic_id, id, question)``, ``tokens(topic_id, words)``; a word counts where a source holds it as a whole word.
    """
    rows = questions.filter(F.length("question") >= 10).select("topic_id", "id", content_words(F.col("question"), stop).alias("words"))
    rows = without_heading(rows, headings, stop)
    asked = rows.select("topic_id", "id", F.explode("words").alias("word"))
    known = tokens.select("topic_id", F.explode(F.array_distinct("words")).alias("word")).distinct().withColumn("known", F.lit(1))
    share = asked.join(known, ["topic_id", "word"], "left").groupBy("topic_id", "id").agg(F.round(F.avg(F.coalesce("known", F.lit(0))), 6).alias("share"))
    return share.filter("share < 0.8").withColumn("priority", F.when(F.col("share") < 0.6, "high").otherwise("medium"))


def gap_subtopic(queries: DataFrame, headings: DataFrame, keyword: str, stop: list[str]) -> DataFrame:
    """``(topic_id, id)``: queries of five characters or more without a heading, other than the keyword's words."""
    own = sorted({w for w in keyword.lower().split() if len(w) >= 4 and w not in stop})
    rows = queries.filter(F.length("question") >= 5).select("topic_id", "id", content_words(F.col("question"), stop).alias("words"))
    return without_heading(rows.filter(F.array_join("words", " ") != " ".join(own)), headings, stop).select("topic_id", "id")


def heading_of(question: Column, leads: list[str]) -> Column:
    """A question as a heading: without its marks and a leading word of ``leads``, with a capital."""
    bare = F.trim(F.regexp_replace(question, r"\?+\s*$", ""))
    if leads:
        bare = F.regexp_replace(bare, rf"(?i)^(?:{'|'.join(leads)})\s+", "")
    return F.concat(F.upper(bare.substr(1, 1)), bare.substr(2, 1 << 30))


def merge_gaps(gaps: DataFrame, stop: list[str], limit: int = 15, leads: list[str] = [], suggest: int = 3, kinds: tuple[str, ...] = ("unanswered", "subtopic")) -> DataFrame:
    """``(topic_id, rank, id, kind, priority, heading, suggested)`` of ``gaps(topic_id, id, kind, question, priority)``.

    Gaps with equal first three content words once, the high ones first; the heading form of each, and whether it is one of the
    first ``suggest`` high ones of ``kinds``. A gap without content words is none.
    """
    level = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    rows = gaps.withColumn("norm", F.array_join(F.slice(content_words(F.col("question"), stop), 1, 3), " ")).filter("norm <> ''")
    rows = rows.groupBy("topic_id", "norm").agg(F.min(F.struct(level.alias("level"), "id", "kind", "priority", "question")).alias("g"))
    rows = ranked(rows.select("topic_id", "g.*"), limit, F.asc("level"), F.asc("id"), F.asc("kind"))
    asked = (F.col("level") == 0) & F.col("kind").isin(*kinds)
    place = F.sum(asked.cast("int")).over(Window.partitionBy("topic_id").orderBy("rank"))
    return rows.select("topic_id", "rank", "id", "kind", "priority", heading_of(F.col("question"), leads).alias("heading"), (asked & (place <= suggest)).alias("suggested"))


def topic_class(text: Column, lists: dict[str, list[str]]) -> Column:
    """The class with most listed terms in the text, the first of equals, and a confidence of a third per term."""
    low = F.lower(text)
    scored = [F.struct(sum([low.contains(t).cast("int") for t in terms], F.lit(0)).alias("hits"), F.lit(-k).alias("order"), F.lit(c).alias("class")) for k, (c, terms) in enumerate(lists.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, F.struct(best["class"].alias("class"), F.round(F.least(F.lit(1.0), best["hits"] / 3), 4).alias("confidence")))


def covered_shares(cands: DataFrame, rows: DataFrame, sizes: DataFrame, above: float, block: int) -> DataFrame:
    """``(label, cand, hits)``: how many of ``rows(label, vec_id, unit)`` of its label have a cosine over ``above`` with each candidate.

    Both sides of a label are dealt to blocks of about ``block`` vectors and every pair of blocks is one product of matrices, so a task holds two
    blocks whatever the label's size; only counts leave it. ``sizes(label, n_rows, n_cands)`` tells how many blocks there are.
    """
    dealt = sizes.select("label", F.ceil(F.col("n_rows") / block).cast("int").alias("parts"), F.ceil(F.col("n_cands") / block).cast("int").alias("chunks"))
    spread = lambda df, own, all_of: df.join(dealt, "label").withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(own + "s")).cast("int")).withColumn(all_of, F.explode(F.sequence(F.lit(0), F.col(all_of + "s") - 1)))
    columns = ["label", "part", "chunk", "asked", "vec_id", "unit"]
    left = spread(cands.select("label", "vec_id", "unit"), "chunk", "part").withColumn("asked", F.lit(True)).select(columns)
    right = spread(rows.select("label", "vec_id", "unit"), "part", "chunk").withColumn("asked", F.lit(False)).select(columns)
    kinds = [f"{c} {rows.schema[s].dataType.simpleString()}" for c, s in (("label", "label"), ("cand", "vec_id"))]

    def product(block_rows: pa.Table) -> pa.Table:
        asked = block_rows.column("asked").to_numpy()
        units = block_rows.column("unit").combine_chunks()
        matrix = units.flatten().to_numpy().reshape(len(units), -1)
        hits = (matrix[asked] @ matrix[~asked].T > above).sum(axis=1)
        mine = block_rows.filter(pa.array(asked))
        return pa.table({"label": mine.column("label"), "cand": mine.column("vec_id"), "hits": pa.array(hits, type=pa.int64())})

    partial = left.unionByName(right).groupBy("label", "part", "chunk").applyInArrow(product, f"{', '.join(kinds)}, hits bigint")
    return partial.groupBy("label", "cand").agg(F.sum("hits").alias("hits"))


def semantic_gaps(vectors: DataFrame, limit: int = 15, first: int = 64, block: int = 2048) -> DataFrame:
    """``(label, vec_id, sim, coverage, score, priority, rank)``: vectors near the keyword vector, the smallest id, that few others cover.

    A score is at most the similarity to the keyword, so vectors under 0.15 are out. The others are taken in ranges of falling
    similarity, about ``first`` of a label and then twice as many as before, each against all vectors of its label in blocks, until
    no similarity left in the label can reach its last rank: the result is that of all vectors. What a range finds is written before
    the next one. At worst, where vectors cover each other so well that no rank is reached, all pairs of a label are multiplied, in as many
    rounds as the logarithm of its size.
    """
    key = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("key"), F.min("vec_id").alias("first"))
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    unit = F.transform("embedding", lambda x: F.when(F.col("norm") > 0, x.cast("double") / F.col("norm")).otherwise(0.0))
    rows = vectors.join(key, "label").filter("vec_id <> first").withColumns({"sim": cosine(F.col("embedding"), F.col("key")), "norm": norm})
    rows = materialise(rows.select("label", "vec_id", "sim", unit.alias("unit"), (F.col("norm") > 0).cast("long").alias("itself")))
    bins = rows.filter("sim >= 0.15").groupBy("label", F.floor(F.col("sim") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("label").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = bins.withColumn("turn", F.floor(F.log2(F.coalesce(F.sum("n").over(before), F.lit(0)) / first + 1)).cast("int"))
    near = rows.filter("sim >= 0.15").withColumn("bin", F.floor(F.col("sim") * 1000)).join(ranges.drop("n"), ["label", "bin"]).drop("bin")
    ranges = materialise(ranges)
    near, totals = materialise(near), rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    open_labels, found = ranges.select("label").distinct(), None
    best = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    for turn in sorted(r.turn for r in ranges.select("turn").distinct().collect()):
        cands = near.filter(F.col("turn") == turn).join(open_labels, "label", "left_semi")
        sizes = materialise(cands.groupBy("label").agg(F.count(F.lit(1)).alias("n_cands")).join(totals, "label"))
        hits = covered_shares(cands, rows.join(sizes.select("label"), "label", "left_semi"), sizes, 0.55, block)
        scored = cands.join(sizes, "label").join(hits.withColumnRenamed("cand", "vec_id"), ["label", "vec_id"])
        coverage = F.when(F.col("n_rows") > 1, (F.col("hits") - F.col("itself")) / (F.col("n_rows") - 1)).otherwise(0.5)
        scored = scored.select("label", "vec_id", "sim", coverage.alias("coverage")).withColumn("score", F.col("sim") * (1 - F.col("coverage")))
        found = scored if found is None else found.unionByName(scored)
        found = materialise(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).drop("rank"))
        bar = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        left = ranges.filter(F.col("turn") > turn).groupBy("label").agg(((F.max("bin") + 1) / 1000).alias("most")).join(bar, "label", "left")
        open_labels = materialise(left.filter((F.coalesce("n", F.lit(0)) < limit) | (F.col("most") >= F.greatest("least", F.lit(0.15)))).select("label"))
        if open_labels.isEmpty():
            break
    if found is None:
        found = near.select("label", "vec_id", "sim", F.lit(0.5).alias("coverage"), F.col("sim").alias("score"))
    rows = found.filter("score >= 0.15").withColumn("rank", F.row_number().over(best))
    level = F.when((F.col("coverage") < 0.25) & (F.col("sim") > 0.5), "high").when((F.col("coverage") < 0.5) & (F.col("sim") > 0.4), "medium").otherwise("low")
    return rows.select("label", "vec_id", F.round("sim", 6).alias("sim"), F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"), level.alias("priority"), F.col("rank").cast("long").alias("rank"))


def parse_triplets(payloads: DataFrame, schema: str, text: str = "payload") -> DataFrame:
    """One row per object of the JSON array in a text; fences go, a truncated array ends at its last whole object, other text gives none."""
    body = F.regexp_replace(F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)\[.*", 0), r",\s*\]", "]")
    whole = F.from_json(F.regexp_extract(body, r"(?s)^.*\]", 0), f"array<struct<{schema}>>")
    cut = F.from_json(F.concat(F.regexp_extract(body, r"(?s)^.*\}", 0), F.lit("]")), f"array<struct<{schema}>>")
    keys = [c for c in payloads.columns if c != text]
    return payloads.select(*keys, F.explode(F.coalesce(whole, cut)).alias("t")).filter("t IS NOT NULL").select(*keys, "t.*")


def normalise_facts(df: DataFrame, categories: tuple = ("price", "date", "measure", "property")) -> DataFrame:
    """Facts with a subject and an object of two characters or more, a known type and category, a confidence of 0.3 to 0.95."""
    rows = df.withColumns({"subject": F.trim("subject"), "object": F.trim("object")}).filter((F.length("subject") >= 2) & (F.length("object") >= 2))
    return rows.withColumns({
        "ttype": F.when(F.col("ttype").isin("spo", "eav"), F.col("ttype")).otherwise("spo"),
        "category": F.when(F.col("category").isin(*categories), F.col("category")).otherwise("property"),
        "confidence": F.greatest(F.lit(0.3), F.least(F.lit(0.95), "confidence")),
    })


def drop_shop_triplets(df: DataFrame, pattern: str) -> DataFrame:
    """Triplets whose subject and object name no shop or platform."""
    return df.filter(~F.concat_ws(" ", F.lower("subject"), F.lower("object")).rlike(pattern))


def key_triplet(df: DataFrame) -> DataFrame:
    """``(topic_id, path)``: the most confident triplet of a topic as a path."""
    best = df.groupBy("topic_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "subject", "predicate", "object")).alias("b"))
    return best.select("topic_id", F.concat_ws(" → ", "b.subject", "b.predicate", "b.object").alias("path"))


def heading_plan(patterns: DataFrame, default: list[str], limit: int = 8) -> DataFrame:
    """``(topic_id, rank, heading)``: patterns that must or should stand first, then others, then the default headings."""
    level = F.when(F.col("class").isin("MUST", "HIGH"), 1).otherwise(2)
    rows = patterns.select("topic_id", level.alias("level"), F.col("rank").alias("k"), F.col("sample").alias("heading"))
    spare = patterns.select("topic_id").distinct().select("topic_id", F.lit(3).alias("level"), F.posexplode(F.array(*[F.lit(d) for d in default])).alias("k", "heading"))
    return ranked(rows.unionByName(spare), limit, F.asc("level"), F.asc("k")).select("topic_id", "rank", "heading")


def rank_issues(rows: DataFrame, rules: list[tuple[str, str]], severity: dict[str, int], skip: list[str], limit: int = 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, rank, rule, category, place)``: the first place of each rule's phrase, by severity and place; one row's own array."""
    low = F.lower(text)
    found = [F.when(low.contains(r), F.struct(F.lit(severity.get(c, 9)).alias("severity"), (F.instr(low, r) - 1).cast("long").alias("place"), F.lit(r).alias("rule"), F.lit(c).alias("category"))) for r, c in rules if r not in skip]
    each = F.slice(F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull())), 1, limit)
    return rows.select(key, F.posexplode(each).alias("k", "i")).select(key, (F.col("k") + 1).cast("long").alias("rank"), "i.rule", "i.category", "i.place")


def issue_counts(rows: DataFrame, rules: list[tuple[str, str]], skip: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, category, n)``: how many rules of each category a text breaks, before any limit; one row's own array."""
    low = F.lower(text)
    kinds = list(dict.fromkeys(c for r, c in rules if r not in skip))
    counts = [F.struct(F.lit(k).alias("category"), sum([low.contains(r).cast("long") for r, c in rules if c == k and r not in skip], F.lit(0).cast("long")).alias("n")) for k in kinds]
    return rows.select(key, F.explode(F.array(*counts)).alias("c")).select(key, "c.*").filter("n > 0")


def fallback_variants(topics: DataFrame, text: str = "heading") -> DataFrame:
    """Add ``variant``: the keyword, and with its words reversed where it has several."""
    low = F.lower(F.trim(text))
    turned = F.array_join(F.reverse(F.split(low, r"\s+")), " ")
    return topics.withColumn("variant", F.explode(F.when(low.rlike(r"\s"), F.array(low, turned)).otherwise(F.array(low))))


def sequence_hits(toks: DataFrame, phrases: list[str], key: str = "doc_id") -> DataFrame:
    """``(key, phrase, n)``: overlapping places where a phrase's words stand in a row."""
    def places(p: str) -> Column:
        words = p.split()
        starts = F.sequence(F.lit(1), F.size("words") - len(words) + 1)
        hits = F.filter(starts, lambda i: F.slice("words", i, len(words)) == F.array(*[F.lit(w) for w in words]))
        return F.struct(F.lit(p).alias("phrase"), F.when(F.size("words") >= len(words), F.size(hits)).otherwise(0).cast("long").alias("n"))

    return toks.select(key, F.explode(F.array(*[places(p) for p in phrases])).alias("h")).select(key, "h.*").filter("n > 0")


def lemma_matches(toks: DataFrame, budgets: list[tuple[str, int]], lemmas: dict[str, str] | None = None, wider: int = 2, key: str = "doc_id") -> DataFrame:
    """``(key, phrase, exact, fuzzy)`` of ``toks(key, words)`` for phrases with the most uses that count.

    Exact places are runs of the phrase's lemmas, overlapping ones too. While fewer than the most are found, windows of the phrase's
    length and up to ``wider`` more words that hold all its lemmas count too, from the left: the first and shortest that meets neither an
    exact place nor an earlier window. All is done in the text's own row: the places of the phrases' words and the exact places are columns, found once
    a text, and windows are sought only where they reach a place of the phrase's rarest word. ``lemmas`` is a short lexicon of written forms; other words are
    their own lemma.
    """
    listed = F.create_map(*[F.lit(x) for pair in sorted((lemmas or {}).items()) for x in pair]) if lemmas else None
    words = F.transform("words", lambda w: F.coalesce(listed[w], w)) if lemmas else F.col("words")
    split = [[(lemmas or {}).get(w, w) for w in phrase.lower().split()] for phrase, _ in budgets]
    each = sorted({w for parts in split for w in parts})
    places = {w: F.col(f"__w{j}") for j, w in enumerate(each)}
    rows = toks.select(key, words.alias("words")).withColumns({f"__w{j}": F.filter(F.transform("words", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()) for j, w in enumerate(each)})  # noqa: B023
    rows = rows.withColumns({f"__e{j}": F.filter(places[parts[0]], lambda i: F.slice("words", i + 1, len(parts)) == F.array(*[F.lit(w) for w in parts])) for j, parts in enumerate(split)})  # noqa: B023

    def matches(j: int, parts: list[str], phrase: str, most: int) -> Column:
        k, asked, taken = len(parts), F.array(*[F.lit(w) for w in parts]), F.col(f"__e{j}")
        rare = F.array_min(F.array(*[F.struct(F.size(places[w]).alias("n"), places[w].alias("at")) for w in sorted(set(parts))]))["at"]
        near = F.flatten(F.transform(rare, lambda p: F.sequence(F.greatest(F.lit(0), p - (k + wider - 1)), F.least(p, F.size("words") - k))))
        starts = F.when(F.size("words") >= k, F.array_distinct(near)).otherwise(F.array().cast("array<int>"))  # in order, as the places are
        lacks = lambda i, n: F.size(F.array_except(asked, F.slice("words", i + 1, n))) > 0

        def window(i: Column) -> Column:
            """Length of the shortest window at ``i``, 0 if there is none."""
            free = lambda n: (i + n <= F.size("words")) & ~lacks(i, n) & ~F.exists(taken, lambda s: (s < i + n) & (s + k > i))
            found = F.lit(0)
            for n in range(k + wider, k - 1, -1):
                found = F.when(free(n), n).otherwise(found)
            return found

        ends = F.filter(F.transform(F.filter(starts, lambda i: ~lacks(i, k + wider)), lambda i: F.struct(i.alias("at"), window(i).alias("n"))), lambda w: w["n"] > 0)
        room = F.lit(most) - F.size(taken)
        take = lambda acc, w: F.when((w["at"] >= acc["free"]) & (acc["n"] < room), F.struct((w["at"] + w["n"]).alias("free"), (acc["n"] + 1).alias("n"))).otherwise(acc)
        searched = F.aggregate(ends, F.struct(F.lit(0).alias("free"), F.lit(0).alias("n")), take, lambda acc: acc["n"])
        present = reduce(lambda a, b: a & b, [F.size(places[w]) > 0 for w in set(parts)])
        fuzzy = F.when(present & (room > 0), searched).otherwise(0) if k > 1 else F.lit(0)  # a window with a single word's lemma meets its exact place
        return F.struct(F.lit(phrase).alias("phrase"), F.size(taken).cast("long").alias("exact"), fuzzy.cast("long").alias("fuzzy"))

    found = [matches(j, parts, *budgets[j]) for j, parts in enumerate(split)]
    return rows.select(key, F.explode(F.array(*found)).alias("h")).select(key, "h.*").filter("exact + fuzzy > 0")


def crosscheck_lines(df: DataFrame, first: str, second: str) -> Column:
    """The first extraction without lines under 50 characters of whose longer words less than half stand in the second.

    A second extraction of 200 characters or less checks nothing; it replaces an empty first one.
    """
    a, b = F.coalesce(F.col(first), F.lit("")), F.coalesce(F.col(second), F.lit(""))
    long = lambda x: F.filter(F.split(F.lower(x), r"\s+"), lambda w: F.length(w) > 3)
    known = lambda x: F.filter(long(x), lambda w: F.contains(F.lower(b), w))
    kept = F.filter(F.split(a, "\n"), lambda x: (F.length(x) >= 50) | (2 * F.size(known(x)) >= F.size(long(x))))
    return F.when(F.trim(a) == "", b).when(F.length(b) <= 200, a).otherwise(F.array_join(kept, "\n"))


def competitor_table(pages: DataFrame, limit: int = 6) -> DataFrame:
    """``(topic_id, rank, page_id, words, n_headings, headings, opening)``: the longest pages of each topic.

    Texts are cut before the ranking, and every partition drops all but its own first rows of a topic.
    """
    main = page_text.html_main_text(F.col("html"))
    heads = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)), lambda h: F.trim(F.regexp_replace(h, "<[^>]+>", "")))
    rows = pages.withColumns({"main": main, "heads": heads}).withColumn("words", F.size(words_of(F.col("main"))).cast("long"))
    rows = rows.select("topic_id", "page_id", "words", F.size("heads").cast("long").alias("n_headings"), F.array_join(F.slice("heads", 1, 12), " | ").alias("headings"), F.substring("main", 1, 400).alias("opening"))
    return ranked(rows, limit, F.desc("words"), F.asc("page_id"))


def flatten_payload(events: DataFrame, text: str = "props", keys: tuple = ("event_id",)) -> DataFrame:
    """``(keys, name, value)``: the fields of a JSON object, one row each; other text gives none."""
    return events.select(*keys, F.explode(F.from_json(text, "map<string,string>")).alias("name", "value"))


def scalar(value: Column, path: str) -> Column:
    """The text, number or truth value at ``path`` of a variant as text; null for anything else."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(~F.schema_of_variant(found).rlike("^(?:OBJECT|ARRAY|VOID)"), F.try_variant_get(value, path, "string"))


def items(value: Column, path: str) -> Column:
    """The items of a list at ``path`` of a variant; an object in its place is the only one, anything else is none."""
    found = F.try_variant_get(value, path, "variant")
    alone = F.when(F.schema_of_variant(found).startswith("OBJECT"), F.array(found))
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), alone, F.array().cast("array<variant>"))


def flatten_serp(payloads: DataFrame, key: str = "topic_id", text: str = "payload") -> DataFrame:
    """``(key, kind, pos, text, answer, link)``: the five kinds of search signals in a JSON payload; other text gives none.

    Results, questions with answers, the answer box (its answer, else its snippet, of 1000 characters), the overview (its
    text, else its snippet, of 2000, with its first five sources) and ten queries. The payload is read as a variant, without a schema: fields may be
    missing, more or of another type, and every signal that can be told stays; questions and queries may also be plain texts.
    """
    rows = payloads.select(key, F.try_parse_json(F.col(text)).alias("p"))
    p = F.col("p")
    row = lambda kind, pos, text, answer, link: F.struct(F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), text.alias("text"), answer.alias("answer"), link.alias("link"))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    organic = F.transform(items(p, "$.organic_results"), lambda x, i: row("result", i, scalar(x, "$.title"), scalar(x, "$.snippet"), scalar(x, "$.link")))
    asked = F.transform(items(p, "$.related_questions"), lambda x, i: row("question", i, F.coalesce(scalar(x, "$.question"), scalar(x, "$")), scalar(x, "$.snippet"), scalar(x, "$.link")))
    queries = F.filter(F.transform(items(p, "$.related_searches"), lambda x: F.coalesce(scalar(x, "$.query"), scalar(x, "$"))), lambda q: F.coalesce(q, F.lit("")) != "")
    related = F.transform(F.slice(queries, 1, 10), lambda q, i: row("query", i, q, none, none))
    box = F.coalesce(F.nullif(scalar(p, "$.answer_box.answer"), F.lit("")), scalar(p, "$.answer_box.snippet"))
    over = F.coalesce(F.nullif(scalar(p, "$.ai_overview.text"), F.lit("")), scalar(p, "$.ai_overview.snippet"))
    sources = F.array_join(F.transform(F.slice(items(p, "$.ai_overview.sources"), 1, 5), lambda s: scalar(s, "$.link")), " ")
    single = F.array(F.when(box.isNotNull(), row("answer", zero, F.coalesce(scalar(p, "$.answer_box.title"), box), F.substring(box, 1, 1000), scalar(p, "$.answer_box.link"))), F.when(over.isNotNull(), row("overview", zero, F.substring(over, 1, 2000), none, sources)))
    return rows.select(key, F.explode(F.concat(organic, asked, related, F.array_compact(single))).alias("s")).select(key, "s.*").filter("text <> ''")


def best_text(pages: DataFrame, nav: str, stop: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, content)``: the lines of a page's main text that its paragraphs bear out, without artifacts and navigation, blanks collapsed.

    One stage: main text by lines, checked against the text of ``p`` elements as the second extraction, then clean-up of
    artifacts and lines.
    """
    paragraphs = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), "\n")
    second = F.regexp_replace(paragraphs, "<[^>]+>", " ")
    rows = pages.select(key, page_text.html_main_text(F.col(html), lines=True).alias("first"), second.alias("second"))
    checked = rows.select(key, page_text.strip_artifacts(crosscheck_lines(rows, "first", "second")).alias("text"))
    return page_text.clean_lines(checked, nav, stop, key).select(key, page_text.finish_text(F.col("text")).alias("content"))
