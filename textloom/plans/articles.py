"""Article checks over ``documents`` as registered queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import topic as T
from textloom.functions.lists import BUDGETS, SCRIPTS, SHOP, STOP
from textloom.operators import articles as A
from textloom.operators.terms import quality_reason
from textloom.plans import tables as t, terms

CHARS, TARGET = "%$#|", 400
ENTITIES = ["license", "the", "idiot", "apache license"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prepared(t.articles(spark, sf_dir))


def j6_fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_facts(_rows(spark, sf_dir), T.HARD_FACTS).select("doc_id", "facts_found", "facts_pct", "facts_pass")


def j10_brand_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.brand_candidates(_rows(spark, sf_dir), ["license"])


def j11_meta_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.meta_comments(_rows(spark, sf_dir), [*T.META, "licen[cs]e"])


def j12_keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.keyword_density(_rows(spark, sf_dir), "the")


def j13_bold_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("doc_id", F.explode(A.bold_spans(F.col("body"))).alias("span"))


def j14_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.validate(A.with_findings(_rows(spark, sf_dir), T.FORBIDDEN, ENTITIES, T.HARD_FACTS, T.OPENERS, CHARS, T.BANNED, T.KEYWORD))


def j16_structure_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.structure_issues(_rows(spark, sf_dir), "the", T.META_OPENERS)


def j18_fuzzy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fuzzy_hits(_rows(spark, sf_dir), [*T.EXPECTED, "thereunder", "idiots"])


def j19_check_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["first_char", "first_word", "subject_share", "h2_with_entity", "position_status", "h1_status", "early_status", "h2_status", "subject_status", "salience_points"]
    return A.with_salience(_rows(spark, sf_dir), T.KEYWORD, T.EXPECTED).select("doc_id", *columns)


def j20_check_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_pairs(_rows(spark, sf_dir), T.PAIRS).select("doc_id", "pairs_found", "pair_places", "pairs_status")


def j21_check_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_triples(_rows(spark, sf_dir), T.TRIPLES).select("doc_id", "triples_pass", "triples_warn", "triples_fail", "triples_pct")


def j21_triple_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.triple_findings(_rows(spark, sf_dir), T.TRIPLES)


def j22_mention_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.with_variety(_rows(spark, sf_dir), T.NAMED, T.NOMINAL, T.PRONOMINAL)
    return rows.select("doc_id", "n_named", "n_nominal", "n_pronominal", "named_pct", "nominal_pct", "pronominal_pct", "variety_status")


def j23_check_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_causal(_rows(spark, sf_dir), T.CAUSAL, T.MECHANISM).select("doc_id", "causal_covered", "causal_explained", "causal_pct")


def j23_causal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.causal_findings(_rows(spark, sf_dir), T.CAUSAL, T.MECHANISM)


def j24_check_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_opening(_rows(spark, sf_dir), T.KEYWORD, T.EXPECTED, T.DEFINITION, T.PREVIEW).select("doc_id", "opening_points", "opening_status")


def j25_naming_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_naming(_rows(spark, sf_dir), T.KEYWORD, T.NAMED).select("doc_id", "naming_stems", "naming_status")


def j25_naming_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.naming_findings(_rows(spark, sf_dir), T.KEYWORD, T.NAMED)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.with_variety(_rows(spark, sf_dir), T.NAMED, T.NOMINAL, T.PRONOMINAL)
    rows = A.with_triples(A.with_pairs(A.with_facts(rows, T.HARD_FACTS), T.PAIRS), T.TRIPLES)
    rows = A.with_opening(A.with_causal(rows, T.CAUSAL, T.MECHANISM), T.KEYWORD, T.EXPECTED, T.DEFINITION, T.PREVIEW)
    return A.with_salience(rows, T.KEYWORD, T.EXPECTED)


def _scored(spark: SparkSession, sf_dir: str, *also: Column) -> DataFrame:
    return A.compliance_score(_checked(spark, sf_dir), T.WEIGHTS, BUDGETS, len(T.PAIRS), len(T.TRIPLES), len(T.CAUSAL), lambda x: quality_reason(x, STOP, terms.CSS_WORDS, SHOP, terms.NAV), also=also)


def j26_compliance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


GAPS = (T.KEYWORD, ENTITIES, T.QUESTIONS, T.CAUSAL, TARGET)


def j27_audit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit_gaps(A.with_variety(_rows(spark, sf_dir), T.NAMED, T.NOMINAL, T.PRONOMINAL), *GAPS)


def j28_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recommendations(j26_compliance_score(spark, sf_dir), j27_audit_gaps(spark, sf_dir))


def j29_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article: the score, words, their ratio to the target, headings and the number of gaps; all from one pass over the texts."""
    n = F.size("words")
    article = F.struct(n.cast("long").alias("n_words"), F.round(n / TARGET, 4).alias("ratio"), F.size(F.regexp_extract_all("body", F.lit(r"((?m)^##\s)"), F.lit(1))).cast("long").alias("n_h2"))
    return A.audit_report(_scored(spark, sf_dir, article.alias("article"), F.size(A.found_gaps(*GAPS)).cast("long").alias("n_gaps")))


def j30_locate_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.locate_paragraph(_rows(spark, sf_dir), T.SPELLED)


def i6_clean_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = [p for p, _ in SCRIPTS.values()]
    return _rows(spark, sf_dir).select("doc_id", F.md5(A.clean_generated(F.col("body"), T.FORBIDDEN, scripts, T.META)).alias("digest"))


def i9_accept_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite here is the text without its lines of tables and lists."""
    after = F.regexp_replace("body", r"(?m)^.*[|•].*$|^\s*[-*].*$", "")
    return _rows(spark, sf_dir).select("doc_id", A.accept_rewrite(F.col("body"), after).alias("accepted"))


QUERIES = [j6_fact_coverage, j10_brand_candidates, j11_meta_comments, j12_keyword_density, j13_bold_in_prose, j14_validate, j16_structure_issues, j18_fuzzy_hits, j19_check_salience, j20_check_pairs, j21_check_triples, j21_triple_findings, j22_mention_variety, j23_check_causal, j23_causal_findings, j24_check_opening, j25_naming_consistency, j25_naming_findings, j26_compliance_score, j27_audit_gaps, j28_recommendations, j29_audit_report, j30_locate_paragraph, i6_clean_generated, i9_accept_rewrites]


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


_ART = rf"""
am AS (SELECT doc_id, {t.ARTICLE_SQL} AS text FROM documents),
a0 AS (SELECT doc_id, COALESCE(text, '') AS body, lower(COALESCE(text, '')) AS low FROM am),
budgeted AS ({terms._reason('phrase', '(VALUES ' + ', '.join(f"('{p}')" for p, _, _ in BUDGETS) + ') v(phrase)', 'phrase')}),
art AS (SELECT *, list_filter(string_split(low, chr(10)), lambda p: trim(p, ' ') <> '') AS paras, list_filter(regexp_split_to_array(low, '[.!?]+\s+'), lambda p: trim(p, ' ') <> '') AS sents, {_words('low')} AS words,
  CASE WHEN len(regexp_split_to_array(low, '(?m)^##\s')) > 1 THEN regexp_split_to_array(low, '(?m)^##\s')[1] ELSE substring(low, 1, 500) END AS intro FROM a0)"""


def _fz(t: str, phrase: str) -> str:
    p = phrase.lower()
    return f"(contains({t}, '{p}') OR len(list_filter(string_split('{p}', ' '), lambda v: length(v) >= 4 AND contains({t}, substring(v, 1, length(v) * 7 // 10)))) > 0)"


def _sum(flags: list[str]) -> str:
    return "(" + " + ".join(f"({f})::BIGINT" for f in flags) + ")"


def _any(t: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{x}')" for x in terms) + ")"


def _grade(good: str, fair: str) -> str:
    return f"CASE WHEN {good} THEN 'pass' WHEN {fair} THEN 'warn' ELSE 'fail' END"


def _facts() -> str:
    plain = r"regexp_replace({}, '(\d)[\s.,](\d{{3}})', '\1\2', 'g')"
    hits = [f"contains(body, '{f}') OR contains({plain.format('low')}, {plain.format(repr(f.lower()))})" for f in T.HARD_FACTS]
    n = len(T.HARD_FACTS)
    return f"SELECT doc_id, {_sum(hits)} AS facts_found, round(100 * {_sum(hits)} / {n}, 2) AS facts_pct, round(100 * {_sum(hits)} / {n}, 2) >= 70 AS facts_pass FROM art"


def _pairs() -> str:
    each = "[" + ", ".join(f"len(list_filter(paras, lambda p: contains(p, '{a}') AND contains(p, '{b}')))" for a, b in T.PAIRS) + "]"
    return f"SELECT doc_id, len(list_filter({each}, lambda n: n > 0)) AS pairs_found, list_sum({each})::BIGINT AS pair_places, CASE WHEN 2 * len(list_filter({each}, lambda n: n > 0)) >= {len(T.PAIRS)} THEN 'pass' ELSE 'warn' END AS pairs_status FROM art"


def _fzs(t: str, phrase: str) -> str:
    p = phrase.lower()
    words = [w for w in p.split() if len(w) > 2]
    stems = [w if len(w) < 4 else w[: max(4, len(w) * 6 // 10)] for w in words]
    return f"(contains({t}, '{p}') OR 2 * {_sum([_any(t, [w]) for w in stems])} >= {max(2, len(words))})" if words else f"contains({t}, '{p}')"


def _triple_states() -> list[tuple[str, str]]:
    out = []
    for s, p, o in T.TRIPLES:
        both, whole = f"{_fz('low', s)} AND {_fz('low', o)}", _fz("low", p)
        near = f"len(list_filter(paras, lambda x: {_fzs('x', s)} AND {_fzs('x', o)} AND ({_fzs('x', p)} OR NOT {whole}))) > 0"
        out.append((f"({both} AND ({whole} OR {near}))", f"({both} AND {near})"))
    return out


def _triples() -> str:
    states = "[" + ", ".join(_grade(clear, found) for found, clear in _triple_states()) + "]"
    counts = ", ".join(f"len(list_filter(s, lambda x: x = '{k}')) AS triples_{k}" for k in ("pass", "warn", "fail"))
    return f"SELECT doc_id, {counts}, round(100 * len(list_filter(s, lambda x: x <> 'fail')) / {len(T.TRIPLES)}, 2) AS triples_pct FROM (SELECT doc_id, {states} AS s FROM art)"


def _triple_rows() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{s}' AS subject, '{p}' AS predicate, '{o}' AS object, {found} AS found, {clear} AS clear, {_grade(clear, found)} AS status FROM art" for (s, p, o), (found, clear) in zip(T.TRIPLES, _triple_states()))


def _variety() -> str:
    kinds = {"named": T.NAMED, "nominal": T.NOMINAL, "pronominal": T.PRONOMINAL}
    counts = ", ".join(f"len(list_filter(sents, lambda s: {_any('s', f)})) AS n_{k}" for k, f in kinds.items())
    shares = ", ".join(f"round(100 * n_{k} / GREATEST(n_named + n_nominal + n_pronominal, 1), 2) AS {k}_pct" for k in kinds)
    return f"SELECT *, CASE WHEN named_pct > 75 OR nominal_pct < 10 OR pronominal_pct < 5 THEN 'warn' ELSE 'pass' END AS variety_status FROM (SELECT *, {shares} FROM (SELECT doc_id, {counts} FROM art))"


def _causal_states() -> list[tuple[str, str]]:
    covered = [f"({_fz('low', a)} AND {_fz('low', b)})" for a, b in T.CAUSAL]
    return [(c, f"({c} AND len(list_filter(sents, lambda s: ({_fz('s', a)} OR {_fz('s', b)}) AND {_any('s', T.MECHANISM)})) > 0)") for c, (a, b) in zip(covered, T.CAUSAL)]


def _causal() -> str:
    covered, told = zip(*_causal_states())
    return f"SELECT doc_id, {_sum(covered)} AS causal_covered, {_sum(told)} AS causal_explained, round(100 * {_sum(covered)} / {len(T.CAUSAL)}, 2) AS causal_pct FROM art"


def _causal_rows() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{a}' AS cause, '{b}' AS effect, {c} AS covered, {e} AS explained, {_grade(e, c)} AS status FROM art" for (a, b), (c, e) in zip(T.CAUSAL, _causal_states()))


def _opening() -> str:
    head = f"array_to_string({_words('intro')}[1:100], ' ')"
    seen = _sum([_fz("head", e) for e in T.EXPECTED])
    points = _sum([f"contains(regexp_split_to_array(intro, '[.!?]')[1], '{T.KEYWORD}')", _any("head", T.DEFINITION), _any("intro", T.PREVIEW), f"2 * {seen} >= {max(2, len(T.EXPECTED))}"])
    return f"SELECT *, {_grade('opening_points >= 3', 'opening_points >= 2')} AS opening_status FROM (SELECT doc_id, {points} AS opening_points FROM (SELECT doc_id, intro, {head} AS head FROM art))"


def _salience() -> str:
    stem, k = T.KEYWORD[:5], T.KEYWORD
    early = _sum([_fz("intro", e) for e in T.EXPECTED])
    n = len(T.EXPECTED)
    return rf"""SELECT doc_id, first_char, first_word, subject_share, h2_with_entity, position_status, h1_status, early_status, h2_status, subject_status,
  (position_status = 'pass')::BIGINT + (h1_status = 'pass')::BIGINT + (h2_status = 'pass')::BIGINT + (subject_status <> 'fail')::BIGINT + (early_status <> 'fail')::BIGINT AS salience_points
FROM (SELECT *, {_grade('first_word BETWEEN 0 AND 200', 'first_char >= 0 AND first_char < 0.3 * length(low)')} AS position_status, {_grade('h2_with_entity >= 2', 'h2_with_entity >= 1')} AS h2_status, {_grade('subject_share >= 0.4', 'subject_share > 0')} AS subject_status
FROM (SELECT *, CASE WHEN first_char < 0 THEN -1 ELSE len({_words('substring(low, 1, GREATEST(first_char, 0))')}) END::BIGINT AS first_word
FROM (SELECT doc_id, low, (strpos(low, '{k}') - 1)::BIGINT AS first_char, round(len(list_filter(sents, lambda s: contains(s, '{stem}') AND contains(array_to_string({_words('s')}[1:5], ' '), '{stem}'))) / GREATEST(len(list_filter(sents, lambda s: contains(s, '{stem}'))), 1), 4) AS subject_share,
  len(list_filter(regexp_extract_all(low, '(?m)^##\s+(.+)$', 1), lambda h: {_fz('h', k)})) AS h2_with_entity, CASE WHEN {_fz(r"regexp_extract(low, '(?m)^#\s+(.+)$', 1)", k)} THEN 'pass' ELSE 'fail' END AS h1_status, {_grade(f'{early} = {n}', f'2 * {early} >= {n}')} AS early_status FROM art)))"""


def _score() -> str:
    count = [(f"((length(low) - length(replace(low, '{p}', ''))) // length('{p}'))", a, b) for p, a, b in BUDGETS]
    sound = [f"(SELECT reason IS NULL FROM budgeted WHERE phrase = '{p}')" for p, _, _ in BUDGETS]
    fine, over = _sum([f"{ok} AND {c} BETWEEN {a} AND {b}" for ok, (c, a, b) in zip(sound, count)]), _sum([f"{ok} AND {c} > {b}" for ok, (c, _, b) in zip(sound, count)])
    named = "CASE WHEN named_pct BETWEEN 35 AND 55 THEN 100.0::DOUBLE ELSE GREATEST(0.0::DOUBLE, 100 - 2 * abs(named_pct - 45)) END"
    parts = {
        "salience": "salience_points / 5 * 100", "triples": f"LEAST(100.0::DOUBLE, (triples_pass + triples_warn) / {len(T.TRIPLES)} * 100)",
        "causal": f"causal_covered / {len(T.CAUSAL)} * 60 + causal_explained / {len(T.CAUSAL)} * 40", "pairs": f"pairs_found / {len(T.PAIRS)} * 100",
        "variety": f"({named} + LEAST(100.0::DOUBLE, nominal_pct / 15 * 100)) / 2", "grams": f"GREATEST(0.0::DOUBLE, {fine} / GREATEST({_sum(sound)}, 1) * 100 - 10 * {over})",
        "opening": "opening_points / 4 * 100", "facts": "facts_pct",
    }
    total = " + ".join(f"{k} * {w}" for k, w in T.WEIGHTS.items())
    joins = " ".join(f"JOIN ({q}) USING (doc_id)" for q in (_salience(), _triples(), _causal(), _pairs(), _variety(), _opening(), _facts()))
    return f"SELECT *, floor(({total}) / {sum(T.WEIGHTS.values())} * 100 + 0.5::DOUBLE) / 100 AS score FROM (SELECT doc_id, {', '.join(f'round({c}, 2) AS {k}' for k, c in parts.items())} FROM art {joins})"


def _gap_rows() -> str:
    out = [("entity", e, f"NOT ({_any('low', [e, e[: max(5, len(e) * 6 // 10)]])})") for e in ENTITIES]
    for q in T.QUESTIONS:
        long = [w for w in q.split() if len(w) > 4]
        out.append(("question", q, f"2 * {_sum([_any('low', [w]) for w in long])} < {len(long)}"))
    out += [("causal", f"{a} - {b}", f"NOT ({_fz('low', a)} AND {_fz('low', b)})") for a, b in T.CAUSAL]
    out += [("structure", "missing_h1", r"NOT regexp_matches(body, '(?m)^#\s+.') AND NOT contains(low, '<h1')"), ("structure", "keyword_not_in_intro", f"NOT contains(array_to_string(words[1:200], ' '), '{T.KEYWORD}')"), ("structure", "too_short", f"10 * len(words) < {6 * TARGET}"), ("structure", "too_long", f"10 * len(words) > {15 * TARGET}"), ("variety", "low_mention_variety", "named_pct > 75")]
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS gap_type, '{i}' AS item FROM art JOIN ({_variety()}) USING (doc_id) WHERE {w}" for k, i, w in out)


def _recommended() -> str:
    rules = [("high", "salience", 60), ("high", "triples", 40), ("high", "opening", 75), ("medium", "causal", 60), ("medium", "variety", 40), ("medium", "grams", 50)]
    weak = " UNION ALL ".join(f"SELECT doc_id, '{p}' AS priority, '{c}' AS area, 1::BIGINT AS n FROM s WHERE {c} < {x}" for p, c, x in rules)
    return f"WITH {_ART}, s AS ({_score()}), g AS ({_gap_rows()}), c AS (SELECT doc_id, CASE WHEN item IN ('missing_h1', 'keyword_not_in_intro') OR gap_type = 'question' THEN 'high' ELSE 'medium' END AS priority, gap_type AS area, count(*) AS n FROM g WHERE gap_type IN ('structure', 'question', 'entity') GROUP BY ALL) {weak} UNION ALL SELECT doc_id, priority, area, LEAST(n, CASE area WHEN 'question' THEN 3 WHEN 'entity' THEN 5 ELSE 99 END) FROM c"


def _validated() -> str:
    item = r"list_transform(string_split(body, chr(10)), lambda x: regexp_matches(x, '^\s*(?:[-*|]|\d+[.)])\s?'))"
    per = "list_transform(paras, lambda p: len(list_filter(regexp_split_to_array(p, '[.!?]+'), lambda s: trim(s, ' ') <> '')))"
    starts = " OR ".join(f"starts_with(trim(s, ' '), '{o}')" for o in T.OPENERS)
    bold = r"regexp_extract_all(regexp_replace(body, '(?m)^#.*$', '', 'g'), '\*\*[^*\n]+\*\*|<strong>[^<]*</strong>')"
    inner = f"SELECT doc_id, body, low, sents, {item} AS it, {per} AS c FROM art"
    counts = {
        "n_forbidden": _sum([_any("low", [p]) for p in T.FORBIDDEN]), "n_missing": _sum(["NOT " + _any("low", [e]) for e in ENTITIES]), "n_facts_missing": _sum(["NOT " + _any("body", [f]) for f in T.HARD_FACTS]),
        "n_uniform": "len(list_filter(range(1, len(c) - 2), lambda i: c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3]))", "n_lists": "len(list_filter(range(1, len(it) + 1), lambda i: it[i] AND (i = 1 OR NOT it[i - 1])))",
        "n_bold": f"len({bold})", "n_openers": f"len(list_filter(sents, lambda s: {starts}))", "n_chars": f"length(body) - length(translate(body, '{CHARS}', ''))",
        "n_banned": _sum([_any("low", [p]) for p in T.BANNED]), "n_sections_without": rf"len(list_filter(regexp_split_to_array(low, '<h2|##\s')[2:], lambda s: NOT contains(s, '{T.KEYWORD}')))",
    }
    return f"WITH {_ART} SELECT *, GREATEST(0, 100 - (5 * n_forbidden + 3 * n_missing + 2 * n_facts_missing + 2 * n_uniform + 2 * n_bold + 2 * n_openers + n_chars + 2 * n_banned + 3 * n_sections_without + 3 * GREATEST(0, n_lists - 3)))::BIGINT AS score FROM (SELECT doc_id, {', '.join(f'{x} AS {k}' for k, x in counts.items())} FROM ({inner}))"


def _issues() -> str:
    first, k = r"trim(regexp_split_to_array(intro, '[.!?]+\s+')[1], ' ')", "the"
    meta = " OR ".join(f"starts_with({first}, '{m}')" for m in T.META_OPENERS)
    title = "substring(trim(string_split(p[i + 1], chr(10))[1], ' '), 1, 20)"
    echo = f"len(list_filter(range(1, len(p)), lambda i: {title} <> '' AND contains(COALESCE(string_split(p[i], '.')[-2], ''), {title}))) > 0"
    kinds = {"intro_meta": meta, "entity_not_first": f"NOT contains(array_to_string({_words(first)}[1:3], ' '), '{k}')", "heading_repeated": echo, "keyword_stuffing": f"(length(low) - length(replace(low, '{k}', ''))) // {len(k)} > 8"}
    return rf"WITH {_ART}, q AS (SELECT *, regexp_split_to_array(low, '(?m)^##\s+') AS p FROM art) " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS issue FROM q WHERE {w}" for n, w in kinds.items())


def _brands() -> str:
    return rf"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(COALESCE(text, ''), '[.!?]+\s+')) AS s FROM (SELECT doc_id, {t.ARTICLE_SQL} AS text FROM documents)), w AS (SELECT doc_id, regexp_extract_all(s, '\p{{L}}+') AS w FROM s),
j AS (SELECT doc_id, unnest(list_transform(list_filter(range(2, len(w) + 1), lambda i: regexp_matches(w[i], '^\p{{Lu}}\p{{Ll}}\p{{L}}{{3,}}$')), lambda i: CASE WHEN i < len(w) AND regexp_matches(w[i + 1], '^\p{{Lu}}\p{{L}}*$') THEN w[i] || ' ' || w[i + 1] ELSE w[i] END)) AS brand FROM w)
SELECT doc_id, brand, count(*) AS n FROM j WHERE lower(brand) <> 'license' GROUP BY ALL"""


def _located() -> str:
    def one(f: str) -> str:
        low, lines = f.lower(), "string_split(body, chr(10))"
        at = f"CASE WHEN contains(body, '{f}') THEN strpos(body, '{f}') ELSE strpos(low, '{low}') END"
        return (
            f"SELECT doc_id, '{f}' AS fragment, CASE WHEN x > 0 THEN 'exact' ELSE 'any case' END AS mode, (CASE WHEN x > 0 THEN x ELSE y END - 1)::BIGINT AS pos, substring(body, GREATEST(1, {at} - 300), {600 + len(f)}) AS context FROM ("
            f"SELECT *, COALESCE(list_position(list_transform({lines}, lambda l: contains(l, '{f}')), true), 0) AS x, COALESCE(list_position(list_transform({lines}, lambda l: contains(lower(l), '{low}')), true), 0) AS y FROM art) WHERE y > 0"
        )

    return f"WITH {_ART} " + " UNION ALL ".join(one(f) for f in T.SPELLED)


def _cleaned() -> str:
    x = "body"
    for p in [*[f"(?i){f}" for f in T.FORBIDDEN], *[p for p, _ in SCRIPTS.values()], *[rf"(?i)[^.!?\n]*(?:{m})[^.!?\n]*[.!?]?" for m in T.META]]:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return rf"WITH {_ART} SELECT doc_id, md5(trim(regexp_replace(regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ')) AS digest FROM art"


def _naming() -> str:
    stem = T.KEYWORD[: max(6, len(T.KEYWORD) * 6 // 10)]
    known = "list_filter([" + ", ".join(f"'{f}'" for f in T.NAMED) + "], lambda f: contains(low, f))"
    return rf"""WITH {_ART}, v AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(low, '\p{{L}}+'), lambda w: starts_with(w, '{stem}'))) AS v FROM art), c AS (SELECT doc_id, v, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, v) AS k FROM c),
u AS (SELECT doc_id, substring(v, 1, 5) AS s FROM r WHERE k <= 10 UNION SELECT doc_id, substring(unnest({known}), 1, 5) FROM art), n AS (SELECT doc_id, count(DISTINCT s) AS m FROM u GROUP BY 1)
SELECT doc_id, COALESCE(m, 0) AS naming_stems, {_grade('COALESCE(m, 0) <= 3', 'COALESCE(m, 0) <= 5')} AS naming_status FROM art LEFT JOIN n USING (doc_id)"""


def _forms() -> str:
    """``nf(doc_id, form, n, known)``: the known forms found, and of the ten most frequent words with the stem those not known."""
    stem = T.KEYWORD[: max(6, len(T.KEYWORD) * 6 // 10)]
    held = "[" + ", ".join(f"'{f}'" for f in T.NAMED) + "]"
    known = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS form, ((length(low) - length(replace(low, '{f}', ''))) // {len(f)})::BIGINT AS n, true AS known FROM art" for f in T.NAMED)
    return rf"""v AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(low, '\p{{L}}+'), lambda w: starts_with(w, '{stem}'))) AS v FROM art), c AS (SELECT doc_id, v, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, v) AS k FROM c),
nf AS (SELECT * FROM ({known}) WHERE n > 0 UNION ALL SELECT doc_id, v, n, false FROM r WHERE k <= 10 AND NOT list_contains({held}, v))"""


_BOLD = rf"SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?m)^#.*$', '', 'g'), '\*\*[^*\n]+\*\*|<strong>[^<]*</strong>')) AS span FROM (SELECT doc_id, {t.ARTICLE_SQL} AS text FROM documents)"
_AFTER = r"regexp_replace(body, '(?m)^.*[|•].*$|^\s*[-*].*$', '', 'g')"
TWINS = {
    "j6_fact_coverage": f"WITH {_ART} {_facts()}",
    "j10_brand_candidates": _brands(),
    "j11_meta_comments": " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '(?i).{{0,30}}(?:{p}).{{0,30}}')) AS context FROM (SELECT doc_id, {t.ARTICLE_SQL} AS text FROM documents)" for p in [*T.META, "licen[cs]e"]),
    "j12_keyword_density": rf"WITH p AS (SELECT doc_id, regexp_split_to_array(lower({t.ARTICLE_SQL}), '(?m)^#{{1,6}}\s') AS p FROM documents), s AS (SELECT doc_id, unnest(range(len(p))) AS section, unnest(p) AS s FROM p), n AS (SELECT doc_id, section, (length(s) - length(replace(s, 'the', ''))) // 3 AS n FROM s) SELECT * FROM n WHERE n > 2",
    "j13_bold_in_prose": _BOLD,
    "j14_validate": _validated(),
    "j16_structure_issues": _issues(),
    "j18_fuzzy_hits": f"WITH {_ART} SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS phrase, {_fz('low', p)} AS whole, len(list_filter(paras, lambda x: {_fzs('x', p)})) AS paragraphs FROM art" for p in [*T.EXPECTED, "thereunder", "idiots"]) + ") WHERE whole OR paragraphs > 0",
    "j19_check_salience": f"WITH {_ART} {_salience()}",
    "j20_check_pairs": f"WITH {_ART} {_pairs()}",
    "j21_check_triples": f"WITH {_ART} {_triples()}",
    "j21_triple_findings": f"WITH {_ART} {_triple_rows()}",
    "j23_causal_findings": f"WITH {_ART} {_causal_rows()}",
    "j25_naming_findings": f"WITH {_ART}, {_forms()} SELECT doc_id, form, n, known FROM nf QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, form, known) <= 10",
    "j22_mention_variety": f"WITH {_ART} {_variety()}",
    "j23_check_causal": f"WITH {_ART} {_causal()}",
    "j24_check_opening": f"WITH {_ART} {_opening()}",
    "j25_naming_consistency": _naming(),
    "j26_compliance_score": f"WITH {_ART} {_score()}",
    "j27_audit_gaps": f"WITH {_ART} {_gap_rows()}",
    "j28_recommendations": _recommended(),
    "j29_audit_report": rf"WITH {_ART}, s AS ({_score()}), g AS (SELECT doc_id, count(*) AS n_gaps FROM ({_gap_rows()}) GROUP BY 1) SELECT doc_id, len(words) AS n_words, round(len(words) / {TARGET}, 4) AS ratio, len(regexp_extract_all(body, '(?m)^##\s')) AS n_h2, score, COALESCE(n_gaps, 0) AS n_gaps FROM art JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)",
    "j30_locate_paragraph": _located(),
    "i6_clean_generated": _cleaned(),
    "i9_accept_rewrites": rf"WITH {_ART} SELECT doc_id, 10 * len({_words(_AFTER)}) >= 7 * len(words) AND 10 * len({_words(_AFTER)}) <= 13 * len(words) AND len(regexp_extract_all(body, '(?m)^##\s')) = len(regexp_extract_all({_AFTER}, '(?m)^##\s')) AS accepted FROM art",
}
