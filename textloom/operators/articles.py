"""Checks of whole articles (family J) as columns of the article's own row.

``prepared`` splits each text once; the checks add columns to its rows, so any number of them
is one pass over the articles without a join or a shuffle. A null text counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.checks import occurrences
from textloom.operators.headings import words_of


def prepared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, body, low, paras, sents, words, intro)``: the text, lower-cased, by line, by sentence and by word."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("low", F.lower("body"))
    parts = F.split("low", r"(?m)^##\s")
    return rows.withColumns({
        "paras": F.filter(F.split("low", "\n"), lambda p: F.trim(p) != ""),
        "sents": F.filter(F.split("low", r"[.!?]+\s+"), lambda s: F.trim(s) != ""),
        "words": words_of(F.col("low")),
        "intro": F.when(F.size(parts) > 1, parts[0]).otherwise(F.substring("low", 1, 500)),
    })


def fuzzy(text: Column, phrase: str) -> Column:
    """Lower-case ``text`` holds the phrase, or the first 70 % of one of its words of four letters or more."""
    p = phrase.lower()
    stems = [w[: len(w) * 7 // 10] for w in p.split() if len(w) >= 4]
    return any_of([text.contains(s) for s in [p, *stems]])


def fuzzy_share(text: Column, phrase: str) -> Column:
    """Lower-case ``text`` holds the phrase, or the first 60 %, four letters at least, of half of its words of three letters or more."""
    p = phrase.lower()
    words = [w for w in p.split() if len(w) > 2]
    stems = [w if len(w) < 4 else w[: max(4, len(w) * 6 // 10)] for w in words]
    half = 2 * count_of([text.contains(w) for w in stems]) >= max(2, len(words)) if words else F.lit(False)
    return text.contains(p) | half


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def count_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("long") for f in flags], F.lit(0).cast("long"))


def graded(good: Column, fair: Column) -> Column:
    return F.when(good, "pass").when(fair, "warn").otherwise("fail")


def percent(part: Column, whole: Column | int) -> Column:
    return F.round(100 * part / F.greatest(F.lit(whole) if isinstance(whole, int) else whole, F.lit(1)), 2)


def fuzzy_hits(rows: DataFrame, phrases: list[str], key: str = "doc_id") -> DataFrame:
    """``(key, phrase, whole, paragraphs)`` for each phrase found: in the text by ``fuzzy``, and the number of its paragraphs that hold it by ``fuzzy_share``."""
    near = lambda p: F.size(F.filter("paras", lambda x: fuzzy_share(x, p))).cast("long")
    found = F.array(*[F.struct(F.lit(p).alias("phrase"), fuzzy(F.col("low"), p).alias("whole"), near(p).alias("paragraphs")) for p in phrases])
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*").filter("whole OR paragraphs > 0")


def with_facts(rows: DataFrame, facts: list[str]) -> DataFrame:
    """Add ``facts_found, facts_pct, facts_pass``: a fact stands as written, or in lower case without thousand marks (70 % pass)."""
    mark = r"(\d)[\s.,](\d{3})"
    plain = F.regexp_replace("low", mark, "$1$2")
    found = count_of([F.col("body").contains(f) | plain.contains(F.regexp_replace(F.lit(f.lower()), mark, "$1$2")) for f in facts])
    rows = rows.withColumn("facts_found", found).withColumn("facts_pct", percent(F.col("facts_found"), len(facts)))
    return rows.withColumn("facts_pass", F.col("facts_pct") >= 70)


def with_pairs(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Add ``pairs_found`` (pairs that share a paragraph), ``pair_places`` and ``pairs_status`` (half of them pass)."""
    def places(a: str, b: str) -> Column:
        return F.size(F.filter("paras", lambda p: p.contains(a) & p.contains(b))).cast("long")

    rows = rows.withColumn("__n", F.array(*[places(*p) for p in pairs]))
    rows = rows.withColumn("pairs_found", F.size(F.filter("__n", lambda n: n > 0)).cast("long")).withColumn("pair_places", F.aggregate("__n", F.lit(0).cast("long"), lambda s, n: s + n)).drop("__n")
    return rows.withColumn("pairs_status", F.when(2 * F.col("pairs_found") >= len(pairs), "pass").otherwise("warn"))


def triple_state(s: str, p: str, o: str) -> tuple[Column, Column]:
    """(found, clear) of a triple: its parts stand in the text, and share a paragraph; where the text lacks the predicate, a paragraph with both ends does."""
    low = F.col("low")
    ends, whole = fuzzy(low, s) & fuzzy(low, o), fuzzy(low, p) if p else F.lit(True)
    near = F.exists("paras", lambda x: fuzzy_share(x, s) & fuzzy_share(x, o) & ((fuzzy_share(x, p) if p else F.lit(True)) | ~whole))
    return ends & (whole | near), ends & near


def triple_findings(rows: DataFrame, triples: list[tuple[str, str, str]], key: str = "doc_id") -> DataFrame:
    """``(key, subject, predicate, object, found, clear, status)``: one row for each article and triple."""
    def one(t: tuple[str, str, str]) -> Column:
        found, clear = triple_state(*t)
        return F.struct(*[F.lit(x).alias(c) for c, x in zip(("subject", "predicate", "object"), t)], found.alias("found"), clear.alias("clear"), graded(clear, found).alias("status"))

    return rows.select(key, F.explode(F.array(*[one(t) for t in triples])).alias("t")).select(key, "t.*")


def with_triples(rows: DataFrame, triples: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``triples_pass, triples_warn, triples_fail, triples_pct``: how many triples are clear, only found, or neither."""
    states = [triple_state(*t) for t in triples]
    rows = rows.withColumn("__s", F.array(*[graded(clear, found) for found, clear in states]))
    for k in ("pass", "warn", "fail"):
        rows = rows.withColumn(f"triples_{k}", F.size(F.filter("__s", lambda x: x == k)).cast("long"))
    return rows.drop("__s").withColumn("triples_pct", percent(F.col("triples_pass") + F.col("triples_warn"), len(triples)))


def with_variety(rows: DataFrame, named: list[str], nominal: list[str], pronominal: list[str]) -> DataFrame:
    """Add the share of sentences by kind of mention, and ``variety_status``."""
    kinds = {"named": named, "nominal": nominal, "pronominal": pronominal}
    for kind, forms in kinds.items():
        rows = rows.withColumn(f"n_{kind}", F.size(F.filter("sents", lambda s: any_of([s.contains(f) for f in forms]))).cast("long"))
    total = F.col("n_named") + F.col("n_nominal") + F.col("n_pronominal")
    rows = rows.withColumns({f"{k}_pct": percent(F.col(f"n_{k}"), total) for k in kinds})
    poor = (F.col("named_pct") > 75) | (F.col("nominal_pct") < 10) | (F.col("pronominal_pct") < 5)
    return rows.withColumn("variety_status", F.when(poor, "warn").otherwise("pass"))


def causal_state(a: str, b: str, mechanism: list[str]) -> tuple[Column, Column]:
    """(covered, explained) of a causal link: both ends stand in the text; and one of them in a sentence with a mechanism word."""
    covered = fuzzy(F.col("low"), a) & fuzzy(F.col("low"), b)
    return covered, covered & F.exists("sents", lambda s: (fuzzy(s, a) | fuzzy(s, b)) & any_of([s.contains(m) for m in mechanism]))


def causal_findings(rows: DataFrame, causal: list[tuple[str, str]], mechanism: list[str], key: str = "doc_id") -> DataFrame:
    """``(key, cause, effect, covered, explained, status)``: one row for each article and link."""
    def one(a: str, b: str) -> Column:
        covered, explained = causal_state(a, b, mechanism)
        return F.struct(F.lit(a).alias("cause"), F.lit(b).alias("effect"), covered.alias("covered"), explained.alias("explained"), graded(explained, covered).alias("status"))

    return rows.select(key, F.explode(F.array(*[one(*c) for c in causal])).alias("t")).select(key, "t.*")


def with_causal(rows: DataFrame, causal: list[tuple[str, str]], mechanism: list[str]) -> DataFrame:
    """Add ``causal_covered, causal_explained, causal_pct``."""
    states = [causal_state(*c, mechanism) for c in causal]
    rows = rows.withColumns({"causal_covered": count_of([c for c, _ in states]), "causal_explained": count_of([e for _, e in states])})
    return rows.withColumn("causal_pct", percent(F.col("causal_covered"), len(causal)))


def with_opening(rows: DataFrame, keyword: str, expected: list[str], definition: list[str], preview: list[str]) -> DataFrame:
    """Add ``opening_points`` (keyword in the first sentence, definition, preview, half of the expected terms) and ``opening_status``."""
    head = F.array_join(F.slice(words_of(F.col("intro")), 1, 100), " ")
    seen = count_of([fuzzy(head, e) for e in expected])
    points = [F.split("intro", "[.!?]")[0].contains(keyword), any_of([head.contains(d) for d in definition]), any_of([F.col("intro").contains(p) for p in preview]), 2 * seen >= max(2, len(expected))]
    rows = rows.withColumn("opening_points", count_of(points))
    return rows.withColumn("opening_status", graded(F.col("opening_points") >= 3, F.col("opening_points") >= 2))


def naming_forms(keyword: str, forms: list[str]) -> Column:
    """``array<struct<n, form, known>>``: known forms found, with overlapping places, and of the ten most frequent words with the keyword's stem those not known.

    The most frequent first, of equals in order.
    """
    stem = keyword.lower()[: max(6, len(keyword) * 6 // 10)]
    held = list(dict.fromkeys(f.lower() for f in forms))
    known = F.array(*[F.struct((-F.regexp_count("low", F.lit(f"(?={re.escape(f)})"))).alias("n"), F.lit(f).alias("form"), F.lit(True).alias("known")) for f in held])
    words = F.filter(F.regexp_extract_all("low", F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: w.startswith(stem))
    variants = F.transform(F.array_distinct(words), lambda v: F.struct((-F.size(F.filter(words, lambda x: x == v))).alias("n"), v.alias("form"), F.lit(False).alias("known")))
    others = F.filter(F.slice(F.array_sort(variants), 1, 10), lambda v: ~v["form"].isin(held))
    return F.array_sort(F.concat(F.filter(known, lambda f: f["n"] < 0), others))


def naming_findings(rows: DataFrame, keyword: str, forms: list[str], key: str = "doc_id") -> DataFrame:
    """``(key, form, n, known)``: the ten most frequent forms of the main entity in each article."""
    listed = F.slice(naming_forms(keyword, forms), 1, 10)
    return rows.select(key, F.explode(listed).alias("f")).select(key, "f.form", (-F.col("f.n")).cast("long").alias("n"), "f.known")


def with_naming(rows: DataFrame, keyword: str, forms: list[str]) -> DataFrame:
    """Add ``naming_stems`` and ``naming_status``: distinct five-letter stems of the forms of the main entity."""
    stems = F.array_distinct(F.transform(naming_forms(keyword, forms), lambda f: F.substring(f["form"], 1, 5)))
    rows = rows.withColumn("naming_stems", F.size(stems).cast("long"))
    return rows.withColumn("naming_status", graded(F.col("naming_stems") <= 3, F.col("naming_stems") <= 5))


def with_salience(rows: DataFrame, keyword: str, expected: list[str], share: float = 0.5) -> DataFrame:
    """Add place, headings, subject share and early mentions of the main entity, with a grade each, and ``salience_points`` of five."""
    stem = keyword.lower()[:5]
    rows = rows.withColumn("first_char", (F.instr("low", keyword) - 1).cast("long"))
    before = F.size(words_of(F.expr("substring(low, 1, greatest(first_char, 0))"))).cast("long")
    rows = rows.withColumn("first_word", F.when(F.col("first_char") < 0, F.lit(-1)).otherwise(before).cast("long"))
    holding = F.filter("sents", lambda s: s.contains(stem))
    led = F.filter("sents", lambda s: s.contains(stem) & F.array_join(F.slice(words_of(s), 1, 5), " ").contains(stem))
    h2 = F.regexp_extract_all("low", F.lit(r"(?m)^##\s+(.+)$"), F.lit(1))
    early = count_of([fuzzy(F.col("intro"), e) for e in expected])
    rows = rows.withColumns({
        "subject_share": F.round(F.size(led) / F.greatest(F.size(holding), F.lit(1)), 4),
        "h2_with_entity": F.size(F.filter(h2, lambda h: fuzzy(h, keyword))).cast("long"),
        "position_status": graded((F.col("first_word") >= 0) & (F.col("first_word") <= 200), (F.col("first_char") >= 0) & (F.col("first_char") < 0.3 * F.length("low"))),
        "h1_status": F.when(fuzzy(F.regexp_extract("low", r"(?m)^#\s+(.+)$", 1), keyword), "pass").otherwise("fail"),
        "early_status": graded(early == len(expected), 2 * early >= len(expected)),
    })
    rows = rows.withColumns({"h2_status": graded(F.col("h2_with_entity") >= 2, F.col("h2_with_entity") >= 1), "subject_status": graded(F.col("subject_share") >= 0.8 * share, F.col("subject_share") > 0)})
    strict = [F.col(f"{c}_status") == "pass" for c in ("position", "h1", "h2")]
    return rows.withColumn("salience_points", count_of(strict + [F.col(f"{c}_status") != "fail" for c in ("subject", "early")]))


def compliance_score(rows: DataFrame, weights: dict[str, int], budgets: list[tuple[str, int, int]], n_pairs: int, n_triples: int, n_causal: int, reason: Callable[[Column], Column] | None = None, key: str = "doc_id", also: tuple[Column, ...] = ()) -> DataFrame:
    """``(key, also, component scores, score)`` of rows that carry the columns of the checks: their weighted mean, 0 to 100.

    Grams of ``budgets`` against which a ``reason`` speaks are left out and the rest counted anew; the optimizer folds these conditions to constants.
    """
    sound = lambda p: reason(F.lit(p)).isNull() if reason else F.lit(True)
    counts = [(occurrences(F.col("low"), F.lit(p)), sound(p), low, high) for p, low, high in budgets]
    kept = F.greatest(count_of([ok for _, ok, _, _ in counts]), F.lit(1))
    fine = count_of([ok & (n >= low) & (n <= high) for n, ok, low, high in counts])
    over = count_of([ok & (n > high) for n, ok, _, high in counts])
    named = F.when(F.col("named_pct").between(35, 55), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - 2 * F.abs(F.col("named_pct") - 45)))
    nominal = F.least(F.lit(100.0), F.col("nominal_pct") / 15 * 100)
    parts = {
        "salience": F.col("salience_points") / 5 * 100,
        "triples": F.least(F.lit(100.0), (F.col("triples_pass") + F.col("triples_warn")) / n_triples * 100),
        "causal": F.col("causal_covered") / n_causal * 60 + F.col("causal_explained") / n_causal * 40,
        "pairs": F.col("pairs_found") / n_pairs * 100,
        "variety": (named + nominal) / 2,
        "grams": F.greatest(F.lit(0.0), fine / kept * 100 - 10 * over),
        "opening": F.col("opening_points") / 4 * 100,
        "facts": F.col("facts_pct"),
    }
    rows = rows.select(key, *also, *[F.round(c, 2).alias(k) for k, c in parts.items()])
    total = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in weights.items()])
    return rows.withColumn("score", F.floor(total / sum(weights.values()) * 100 + 0.5) / 100)


def brand_candidates(rows: DataFrame, allowed: list[str], key: str = "doc_id") -> DataFrame:
    """``(key, brand, n)``: capitalised words of five letters or more inside a sentence, joined with a capitalised successor."""
    name, tail = r"^\p{Lu}\p{Ll}\p{L}{3,}$", r"^\p{Lu}\p{L}*$"

    def of(words: Column) -> Column:
        joined = F.transform(words, lambda w, i: F.when((i > 0) & w.rlike(name), F.when(F.coalesce(F.get(words, i + 1).rlike(tail), F.lit(False)), F.concat_ws(" ", w, F.get(words, i + 1))).otherwise(w)))
        return F.filter(joined, lambda x: x.isNotNull() & ~F.lower(x).isin([a.lower() for a in allowed]))

    each = F.flatten(F.transform(F.split("body", r"[.!?]+\s+"), lambda s: of(F.regexp_extract_all(s, F.lit(r"(\p{L}+)"), F.lit(1)))))
    return rows.select(key, F.explode(each).alias("brand")).groupBy(key, "brand").agg(F.count(F.lit(1)).alias("n"))


def meta_comments(rows: DataFrame, patterns: list[str], key: str = "doc_id") -> DataFrame:
    """``(key, context)``: remarks of an editor, with up to 30 characters of their line on each side.

    A pattern with its surroundings is tried at 31 places for each character, so only texts that the bare pattern is found in are searched for it.
    """
    def contexts(p: str) -> Column:
        return F.when(F.col("body").rlike(f"(?i)(?:{p})"), F.regexp_extract_all("body", F.lit(f"(?i)(.{{0,30}}(?:{p}).{{0,30}})"), F.lit(1))).otherwise(F.array().cast("array<string>"))

    found = F.flatten(F.array(*[contexts(p) for p in patterns]))
    return rows.select(key, F.explode(found).alias("context"))


def keyword_density(rows: DataFrame, keyword: str, most: int = 2, key: str = "doc_id") -> DataFrame:
    """``(key, section, n)``: sections between headings that hold the keyword over ``most`` times."""
    counts = F.transform(F.split("low", r"(?m)^#{1,6}\s"), lambda s: occurrences(s, F.lit(keyword)))
    return rows.select(key, F.posexplode(counts).alias("section", "n")).filter(F.col("n") > most).withColumn("section", F.col("section").cast("long"))


def bold_spans(body: Column) -> Column:
    """Bold spans outside of headings."""
    return F.regexp_extract_all(F.regexp_replace(body, r"(?m)^#.*$", ""), F.lit(r"(\*\*[^*\n]+\*\*|<strong>[^<]*</strong>)"), F.lit(1))


def with_findings(rows: DataFrame, forbidden: list[str], entities: list[str], facts: list[str], openers: list[str], chars: str, banned: list[str] = [], main: str = "", mark: str = r"^\s*(?:[-*|]|\d+[.)])\s?") -> DataFrame:
    """Add one count per kind of finding, sections without the ``main`` entity among them: the numbers behind ``validate``."""
    low, body = F.col("low"), F.col("body")
    per = F.transform("paras", lambda p: F.size(F.filter(F.split(p, r"[.!?]+"), lambda s: F.trim(s) != "")))
    rows = rows.withColumns({"__c": per, "__i": F.transform(F.split("body", "\n"), lambda x: x.rlike(mark))})
    same = F.filter("__c", lambda c, i: (F.get("__c", i + 1) == c) & (F.get("__c", i + 2) == c) & (F.get("__c", i + 3) == c))
    parts = F.split("low", r"<h2|##\s")
    bare = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda s: ~F.contains(s, F.lit(main.lower())))
    groups = F.filter("__i", lambda x, i: x & ~((i > 0) & F.coalesce(F.get("__i", i - 1), F.lit(False))))
    return rows.withColumns({
        "n_forbidden": count_of([low.contains(p) for p in forbidden]),
        "n_missing": count_of([~low.contains(e) for e in entities]),
        "n_facts_missing": count_of([~body.contains(f) for f in facts]),
        "n_uniform": F.size(same).cast("long"),
        "n_lists": F.size(groups).cast("long"),
        "n_bold": F.size(bold_spans(body)).cast("long"),
        "n_openers": F.size(F.filter("sents", lambda s: any_of([F.trim(s).startswith(o) for o in openers]))).cast("long"),
        "n_chars": (F.length("body") - F.length(F.translate("body", chars, ""))).cast("long"),
        "n_banned": count_of([low.contains(p) for p in banned]),
        "n_sections_without": F.size(bare).cast("long"),
    }).drop("__c", "__i")


def validate(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, findings, score)``: 100 less the points of each finding, 0 to 100."""
    points = {"n_forbidden": 5, "n_missing": 3, "n_facts_missing": 2, "n_uniform": 2, "n_bold": 2, "n_openers": 2, "n_chars": 1, "n_banned": 2, "n_sections_without": 3}
    lost = reduce(lambda a, b: a + b, [w * F.col(c) for c, w in points.items()]) + 3 * F.greatest(F.lit(0), F.col("n_lists") - 3)
    return rows.select(key, *points, "n_lists", F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"))


def structure_issues(rows: DataFrame, keyword: str, meta: list[str], key: str = "doc_id") -> DataFrame:
    """``(key, issue)``: intro opens with a remark; entity not in its first three words; a section's last sentence repeats the next heading; keyword over 8 times."""
    first = F.trim(F.split("intro", r"[.!?]+\s+")[0])
    parts = F.split("low", r"(?m)^##\s+")
    title = lambda i: F.substring(F.trim(F.split(F.get(parts, i + 1), "\n")[0]), 1, 20)
    last = lambda s: F.coalesce(F.get(F.reverse(F.split(s, r"\.")), F.lit(1)), F.lit(""))
    echo = F.exists(F.transform(parts, lambda s, i: F.coalesce((title(i) != "") & last(s).contains(title(i)), F.lit(False))), lambda x: x)
    issues = F.array(
        F.when(any_of([first.startswith(m) for m in meta]), "intro_meta"),
        F.when(~F.array_join(F.slice(words_of(first), 1, 3), " ").contains(keyword.lower()[:5]), "entity_not_first"),
        F.when(echo, "heading_repeated"),
        F.when(occurrences(F.col("low"), F.lit(keyword)) > 8, "keyword_stuffing"),
    )
    return rows.select(key, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def audit_gaps(rows: DataFrame, keyword: str, entities: list[str], questions: list[str], causal: list[tuple[str, str]], target: int, key: str = "doc_id") -> DataFrame:
    """``(key, gap_type, item)``: missing entities, questions, causal links and parts of the structure."""
    return rows.select(key, F.explode(found_gaps(keyword, entities, questions, causal, target)).alias("g")).select(key, "g.*")


def found_gaps(keyword: str, entities: list[str], questions: list[str], causal: list[tuple[str, str]], target: int) -> Column:
    """The gaps of ``audit_gaps`` of a row as an array."""
    low, n = F.col("low"), F.size("words")

    def gap(kind: str, item: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("gap_type"), F.lit(item).alias("item")))

    found = [gap("entity", e, ~(low.contains(e) | low.contains(e[: max(5, len(e) * 6 // 10)]))) for e in entities]
    for q in questions:
        long = [w for w in q.lower().split() if len(w) > 4]
        found.append(gap("question", q, 2 * count_of([low.contains(w) for w in long]) < len(long)))
    found += [gap("causal", f"{a} - {b}", ~(fuzzy(low, a) & fuzzy(low, b))) for a, b in causal[:5]]
    found += [
        gap("structure", "missing_h1", ~F.col("body").rlike(r"(?m)^#\s+.") & ~low.contains("<h1")),
        gap("structure", "keyword_not_in_intro", ~F.array_join(F.slice("words", 1, 200), " ").contains(keyword)),
        gap("structure", "too_short", 10 * n < 6 * target),
        gap("structure", "too_long", 10 * n > 15 * target),
        gap("variety", "low_mention_variety", F.col("named_pct") > 75),
    ]
    return F.filter(F.array(*found), lambda g: g.isNotNull())


def audit_report(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, article, score, n_gaps)`` of ``reports(key, article, score, n_gaps)``, a row per article, as a join of articles, scores and counts of gaps by key has it.

    Articles without a key are left out, those that share one meet each other's scores and the sum of their gaps. Only these few numbers are shuffled.
    """
    each = reports.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list("article").alias("articles"), F.collect_list("score").alias("scores"), F.sum("n_gaps").alias("n_gaps"))
    met = each.select(key, F.explode("articles").alias("article"), "scores", "n_gaps")
    return met.select(key, "article.*", F.explode("scores").alias("score"), "n_gaps")


def recommendations(scores: DataFrame, gaps: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, priority, area, n)``: rules on component scores and gaps; questions count up to 3, entities up to 5."""
    rules = [("high", "salience", 60), ("high", "triples", 40), ("high", "opening", 75), ("medium", "causal", 60), ("medium", "variety", 40), ("medium", "grams", 50)]
    each = F.array(*[F.when(F.col(c) < least, F.struct(F.lit(p).alias("priority"), F.lit(c).alias("area"), F.lit(1).cast("long").alias("n"))) for p, c, least in rules])
    weak = scores.select(key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("r")).select(key, "r.*")
    kind = F.when(F.col("item").isin("missing_h1", "keyword_not_in_intro") | (F.col("gap_type") == "question"), "high").otherwise("medium")
    most = F.when(F.col("area") == "question", 3).when(F.col("area") == "entity", 5).otherwise(99)
    open_ = gaps.filter(F.col("gap_type").isin("structure", "question", "entity")).groupBy(key, kind.alias("priority"), F.col("gap_type").alias("area")).agg(F.count(F.lit(1)).alias("n"))
    return weak.unionByName(open_.withColumn("n", F.least("n", most).cast("long")))


def locate_paragraph(rows: DataFrame, fragments: list[str], around: int = 300, key: str = "doc_id") -> DataFrame:
    """``(key, fragment, mode, pos, context)``: the first line with the fragment, as written if any is, else in any case."""
    lines = F.split("body", "\n")

    def place(f: str) -> Column:
        exact = F.array_position(F.transform(lines, lambda p: p.contains(f)), True)
        loose = F.array_position(F.transform(lines, lambda p: F.lower(p).contains(f.lower())), True)
        at = F.when(F.instr("body", f) > 0, F.instr("body", f)).otherwise(F.instr("low", f.lower()))
        context = F.substring(F.col("body"), F.greatest(F.lit(1), at - around), F.lit(2 * around + len(f)))
        return F.when(loose > 0, F.struct(F.lit(f).alias("fragment"), F.when(exact > 0, "exact").otherwise("any case").alias("mode"), (F.when(exact > 0, exact).otherwise(loose) - 1).cast("long").alias("pos"), context.alias("context")))

    return rows.select(key, F.explode(F.filter(F.array(*[place(f) for f in fragments]), lambda x: x.isNotNull())).alias("p")).select(key, "p.*")


def clean_generated(body: Column, forbidden: list[str], scripts: list[str], meta: list[str]) -> Column:
    """Text without forbidden phrases, runs of foreign scripts and sentences with an editor's remark; blanks collapsed.

    The text is cut into sentences first, as one pattern around a remark would try every start of a long sentence.
    """
    for p in [*[f"(?i){f}" for f in forbidden], *scripts]:
        body = F.regexp_replace(body, p, "")
    pieces = F.regexp_extract_all(body, F.lit(r"([^.!?\n]+[.!?]?|[.!?\n])"), F.lit(1))
    body = F.array_join(F.filter(pieces, lambda s: ~s.rlike("(?i)" + "|".join(meta))), "")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def accept_rewrite(before: Column, after: Column) -> Column:
    """A rewritten text is taken if it has 70 to 130 % of the words and as many second-level headings."""
    words = [F.size(words_of(F.coalesce(t, F.lit("")))) for t in (before, after)]
    heads = [F.size(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"((?m)^##\s)"), F.lit(1))) for t in (before, after)]
    return (10 * words[1] >= 7 * words[0]) & (10 * words[1] <= 13 * words[0]) & (heads[0] == heads[1])
