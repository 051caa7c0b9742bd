"""Structure and rule checks over many articles (family J) and corrections (family I)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, sentence)``: pieces between final marks followed by space."""
    rows = docs.select(key, F.posexplode(F.split(text, r"[.!?]+\s+")).alias("pos", "sentence"))
    return rows.withColumn("sentence", F.trim("sentence")).filter(F.col("sentence") != "")


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping places of ``phrase`` in ``text``."""
    return ((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("long")


def phrase_hits(docs: DataFrame, phrases: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, phrase, n)`` for every listed phrase that occurs, in any case; one pass, no join."""
    low = F.lower(F.col(text))
    each = F.array(*[F.struct(F.lit(p.lower()).alias("phrase"), occurrences(low, F.lit(p.lower())).alias("n")) for p in phrases])
    return docs.select(key, F.explode(each).alias("hit")).select(key, "hit.phrase", "hit.n").filter("n > 0")


def char_hits(docs: DataFrame, chars: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n)``: occurrences of banned characters."""
    return docs.select(key, (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long").alias("n")).filter("n > 0")


def opener_hits(docs: DataFrame, openers: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, opener, n)``: sentences by the first listed opener with which they start, counted in the text's own row."""
    low = [o.lower() for o in openers]
    starts = F.transform(F.split(F.lower(F.col(text)), r"[.!?]+\s+"), lambda s: F.coalesce(*[F.when(F.trim(s).startswith(o), F.lit(o)) for o in low]))
    counts = F.array(*[F.struct(F.lit(o).alias("opener"), F.size(F.filter("starts", lambda s: s == o)).cast("long").alias("n")) for o in dict.fromkeys(low)])
    return docs.select(key, starts.alias("starts")).select(key, F.explode(counts).alias("c")).select(key, "c.*").filter("n > 0")


def entity_coverage(docs: DataFrame, required: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_present, n_missing)`` of required terms."""
    low = F.lower(F.col(text))
    present = sum([low.contains(r.lower()).cast("long") for r in required], F.lit(0).cast("long"))
    return docs.select(key, present.alias("n_present"), (F.lit(len(required)) - present).alias("n_missing"))


def uniform_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, n)``: four paragraphs in a row with as many sentences each, found in the text's own row."""
    sentences = lambda p: F.size(F.filter(F.split(p, r"[.!?]+"), lambda s: F.trim(s) != "")).cast("long")
    counted = F.transform(F.split(text, "\n"), lambda p, i: F.when(F.trim(p) != "", F.struct(i.cast("long").alias("pos"), sentences(p).alias("n"))))
    rows = docs.select(key, F.array_compact(counted).alias("p"))
    even = F.filter("p", lambda x, i: reduce(lambda a, b: a & b, [F.coalesce(F.get("p", i + k)["n"] == x["n"], F.lit(False)) for k in (1, 2, 3)]))
    return rows.select(key, F.explode(even).alias("e")).select(key, "e.pos", "e.n")


def list_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = r"^\s*(?:[-*|]|\d+[.)])\s?") -> DataFrame:
    """``(key, groups, items)``: runs of consecutive list lines, counted in the text's own row."""
    rows = docs.select(key, F.transform(F.split(text, "\n"), lambda x: x.rlike(mark)).alias("item"))
    first = F.filter("item", lambda x, i: x & ~F.coalesce(F.when(i > 0, F.get("item", i - 1)), F.lit(False)))
    return rows.select(key, F.size(first).cast("long").alias("groups"), F.size(F.filter("item", lambda x: x)).cast("long").alias("items")).filter("items > 0")


def style_score(docs: DataFrame, forbidden: list[str], openers: list[str], banned: list[str], chars: str, stop: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, counts of findings, spread, score, class)``: points off per finding, 0 to 100, in the article's own row.

    Per use 5 of a forbidden phrase, 4 of a banned opener, 3 of a banned phrase; 2 per banned character up to ten of each; 2 per
    word that begins over three sentences; 3 for four paragraphs of as many sentences, 3 for sentences of like length, 5 for over
    twelve list items, 3 for over three bold spans, 2 for over two straight quotes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, body.alias("body"), F.lower(body).alias("low")).withColumn("sents", F.filter(F.split(F.regexp_replace("low", r"([.!?])\s+", "$1\n\n\n"), "\n\n\n"), lambda s: F.trim(s) != ""))
    uses = lambda phrases: sum([occurrences(F.col("low"), F.lit(p.lower())) for p in phrases], F.lit(0).cast("long"))
    opens = lambda s: reduce(lambda a, b: a | b, [F.trim(s).startswith(o.lower()) for o in openers], F.lit(False))
    starts = F.transform("sents", lambda s: F.split(F.trim(s), r"\s+")[0])
    often = F.filter(F.array_distinct("starts"), lambda w: ~w.isin(stop) & (F.size(F.filter("starts", lambda x: x == w)) > 3))
    lengths = F.filter(F.transform("sents", lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))), lambda n: n > 2)
    mean = F.aggregate("lengths", F.lit(0.0), lambda t, n: t + n) / F.size("lengths")
    square = F.aggregate("lengths", F.lit(0.0), lambda t, n: t + n.cast("double") * n)
    paras = F.filter(F.transform(F.split("body", "\n\n"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.startswith("#"))
    counts = F.transform(paras, lambda p: F.size(F.filter(F.split(p, r"[.!?]+\s+"), lambda s: F.trim(s) != "")))
    even = F.exists(F.transform("counts", lambda c, i: F.coalesce((F.get("counts", i + 1) == c) & (F.get("counts", i + 2) == c) & (F.get("counts", i + 3) == c), F.lit(False))), lambda x: x)
    rows = rows.withColumns({"starts": starts, "lengths": lengths, "counts": counts})
    spread = F.when(F.size("lengths") >= 5, F.round(F.sqrt(F.greatest(F.lit(0.0), square / F.size("lengths") - mean * mean)), 6))
    each = [F.length("body") - F.length(F.translate("body", c, "")) for c in chars]
    rows = rows.select(key, uses(forbidden).alias("n_forbidden"), F.size(F.filter("sents", opens)).cast("long").alias("n_openers"), uses(banned).alias("n_banned"), sum([F.least(n, F.lit(10)) for n in each], F.lit(0)).cast("long").alias("n_chars"), F.size(often).cast("long").alias("n_starts"), even.alias("even"), spread.alias("spread"), F.regexp_count("body", F.lit(r"(?m)^\s*[-•*]\s+")).cast("long").alias("n_items"), F.regexp_count("body", F.lit(r"\*\*[^*]+\*\*")).cast("long").alias("n_bold"), F.regexp_count("body", F.lit("'")).cast("long").alias("n_quotes"))
    off = lambda c, n: F.when(c, n).otherwise(0)
    lost = 5 * F.col("n_forbidden") + 4 * F.col("n_openers") + 3 * F.col("n_banned") + 2 * F.col("n_chars") + 2 * F.col("n_starts")
    lost = lost + off(F.col("even"), 3) + off(F.col("spread") < 3.0, 3) + off(F.col("n_items") > 12, 5) + off(F.col("n_bold") > 3, 3) + off(F.col("n_quotes") > 2, 2)
    rows = rows.withColumn("score", F.greatest(F.lit(0), 100 - lost).cast("long"))
    return rows.withColumn("class", F.when(F.col("score") >= 80, "HIGH").when(F.col("score") >= 60, "MEDIUM").otherwise("LOW"))


def apply_corrections(articles: DataFrame, corrections: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, text, applied, flagged, reasons)``: in order, a correction applies only if its original stands exactly once.

    ``corrections(key, pos, original, replacement)``, perhaps with ``is_instruction``, which is never applied; one fold
    per article. ``reasons`` has one entry per correction: applied, instruction, or how often its original stands.
    """
    told = F.coalesce("is_instruction", F.lit(False)) if "is_instruction" in corrections.columns else F.lit(False)
    todo = corrections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "original", "replacement", told.alias("told")))).alias("todo"))
    none = F.array().cast("array<string>")
    start = lambda t: F.struct(t.alias("text"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("flagged"), none.alias("reasons"))

    def step(acc: Column, c: Column) -> Column:
        n = F.when(F.length(c["original"]) > 0, occurrences(acc["text"], c["original"])).otherwise(0)
        why = F.when(c["told"], "instruction").when(n == 1, "applied").otherwise(F.concat(n.cast("string"), F.lit(" times")))
        reasons = F.concat(acc["reasons"], F.array(why)).alias("reasons")
        done = F.struct(F.replace(acc["text"], c["original"], c["replacement"]).alias("text"), (acc["applied"] + 1).alias("applied"), acc["flagged"].alias("flagged"), reasons)
        return F.when(why == "applied", done).otherwise(F.struct(acc["text"].alias("text"), acc["applied"].alias("applied"), (acc["flagged"] + 1).alias("flagged"), reasons))

    rows = articles.join(todo, key, "left").withColumn("todo", F.coalesce("todo", F.array().cast(todo.schema["todo"].dataType)))
    return rows.select(key, F.aggregate("todo", start(F.col("text")), step).alias("r")).select(key, "r.text", "r.applied", "r.flagged", "r.reasons")


def flag_instructions(corrections: DataFrame, markers: tuple = ("remove", "rephrase", "consider", "change", "delete", "replace", "check", "make sure")) -> DataFrame:
    """Add ``is_instruction``: the replacement tells what to do instead of what to write.

    It is empty or of five characters at most, begins with a marker, removes with a colon or an alternative, quotes after
    a colon, or is a long text that removes or replaces.
    """
    text = F.coalesce("replacement", F.lit(""))
    low = F.lower(F.trim(text))
    flag = (F.length(text) <= 5) | F.contains(low, F.lit(": '")) | F.contains(low, F.lit(':"'))
    flag = flag | (F.contains(low, F.lit("remove")) & (F.contains(low, F.lit(":")) | F.contains(low, F.lit("or "))))
    flag = flag | ((F.length(low) > 200) & low.rlike("remove|replace"))
    for m in markers:
        flag = flag | low.startswith(m)
    return corrections.withColumn("is_instruction", flag)


def foreign_scripts(docs: DataFrame, scripts: dict[str, tuple[str, int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, script, run)``: the first runs of letters of each listed script."""
    def runs(script: str, pattern: str, first: int) -> Column:
        found = F.slice(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), 1, first)
        return F.transform(found, lambda r: F.struct(F.lit(script).alias("script"), r.alias("run")))

    each = F.concat(*[runs(k, p, n) for k, (p, n) in scripts.items()])
    return docs.select(key, F.explode(each).alias("r")).select(key, "r.script", "r.run")


def gram_coverage(docs: DataFrame, budgets: list[tuple[str, int, int | None, float]], strict: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_missing, n_under, n_over, n_ok, coverage_pct, important)``: uses of each phrase against its range; no join.

    Budgets are (phrase, least, most or None, weight). The strict form takes phrases of four characters or more, of three
    times the least at most, and counts fair ones for coverage only if in range; the other phrases of three characters, of
    99 at most, a least of 0 is never missing, and too rare ones count for coverage too. ``important`` lists missing ones of weight 0.3 or more.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    known = [(p, least, most if most is not None else 3 * max(least, 1) if strict else 99, w) for p, least, most, w in budgets if len(p) >= (4 if strict else 3)]

    def state(phrase: str, least: int, most: int, weight: float) -> Column:
        n, least = occurrences(low, F.lit(phrase)), max(least, 1) if strict else least
        kind = F.when((n == 0) & F.lit(least > 0), "missing").when(n < least, "under").when(n > most, "over").otherwise("ok")
        return F.struct(F.lit(phrase).alias("phrase"), F.lit(weight).alias("weight"), kind.alias("kind"))

    rows = docs.select(key, F.array(*[state(*b) for b in known]).alias("s"))

    def count(of: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == of)).cast("long").alias(f"n_{of}")

    missing = F.filter("s", lambda x: (x["kind"] == "missing") & (x["weight"] >= 0.3))
    names = F.transform(F.array_sort(F.transform(missing, lambda x: F.struct((-x["weight"]).alias("w"), x["phrase"].alias("phrase")))), lambda x: x["phrase"])
    rows = rows.select(key, *[count(k) for k in ("missing", "under", "over", "ok")], F.array_join(names, ", ").alias("important"))
    covered = F.col("n_ok") if strict else F.col("n_ok") + F.col("n_under")
    return rows.withColumn("coverage_pct", F.round(100 * covered / max(1, len(known)), 2))
