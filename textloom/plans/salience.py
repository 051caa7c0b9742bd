"""Concepts, salience and relations over the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.lists import ENTITIES, SHOP, STOP
from textloom.operators import entities, grams, salience, terms, text
from textloom.plans import tables as t
from textloom.plans.terms import CSS_WORDS, MODIFIER, NAV, NOUN, _reason
from textloom.plans.twins import _GRAMS, _HEADS, _KEYWORDS, _LIST, _WORDS, TWINS as _BASE

#: Relations and how sentences put them (fixed values).
RELATIONS = [("is", r"(\p{L}+ \p{L}+) is (\p{L}+ \p{L}+)"), ("under", r"(\p{L}+ \p{L}+) under (\p{L}+ \p{L}+)"), ("est", r"(\p{L}+ \p{L}+) est (\p{L}+ \p{L}+)"), ("ist", r"(\p{L}+ \p{L}+) ist (\p{L}+ \p{L}+)")]
BRANDS = ["license", "Question", "mit", "than", "acme"]
PHRASES = [p for p, _ in ENTITIES]


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = terms.noun_runs(grams.tokens(text.documents_as_sources(t.docs(spark, sf_dir))), NOUN, MODIFIER)
    return salience.topical_entities(runs, t.topics(spark, sf_dir), STOP)


def f9_topical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.long(_concepts(spark, sf_dir), "rank")


def f11_salience_topical(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = t.headings(spark, sf_dir).select("topic_id", F.lit(1).alias("level"), "heading")
    topics = t.topics(spark, sf_dir)
    rows = salience.salience_topical(_concepts(spark, sf_dir), text.documents_as_sources(t.docs(spark, sf_dir)), heads, topics, nav=NAV, small=t.few_topics(topics))
    return t.long(rows, "rank", "early", "in_h1", "in_h2")


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.documents_as_sources(t.docs(spark, sf_dir)).select("topic_id", "src_idx", F.filter(F.split("content", r"[.!?]+\s+"), lambda s: F.trim(s) != "").alias("s"))
    sents = rows.select("topic_id", "src_idx", F.size("s").alias("n"), F.posexplode("s").alias("pos", "sentence"))
    heads = t.headings(spark, sf_dir).select("topic_id", F.lit(1).alias("level"), "heading")
    return salience.salience_roles(salience.roles_in_sentences(sents, PHRASES), heads, t.topics(spark, sf_dir))


def f12_salience_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.long(_roles(spark, sf_dir), "rank", "early", "in_h1", "in_h2")


def f19_early_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.long(salience.early_entities(_roles(spark, sf_dir)), "rank")


def f16_main_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = t.topics(spark, sf_dir)
    found = entities.entity_stats(t.mentions(spark, sf_dir), topics.drop("keyword"))
    against = terms.quality_reason(F.col("phrase"), STOP, CSS_WORDS, SHOP, NAV)
    return salience.main_entity(_roles(spark, sf_dir), found, t.headings(spark, sf_dir), topics.select("topic_id", "keyword"), against)


def f15_extract_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.docs(spark, sf_dir).select(F.col("lang").alias("topic_id"), "text")
    return t.long(salience.extract_relations(docs, RELATIONS, PHRASES), "rank")


def f21_match_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("topic_id"), "text")
    return salience.match_brands(rows, BRANDS)


QUERIES = [f9_topical_entities, f11_salience_topical, f12_salience_roles, f15_extract_relations, f16_main_entity, f19_early_entities, f21_match_brands]

_TOPICS = _KEYWORDS + ", ns AS (SELECT topic_id, count(DISTINCT src_idx) AS n_sources FROM src GROUP BY 1), tp AS (SELECT * FROM ns JOIN kw USING (topic_id))"
_KWORDS = f"list_filter(string_split(keyword, ' '), lambda w: length(w) > 2 AND NOT list_contains({_LIST}, w))"
_KEY = rf"""CASE WHEN length(c) BETWEEN 3 AND 80 AND len(w) <= 5 AND len(regexp_extract_all(c, '\p{{L}}')) / GREATEST(length(c), 1) >= 0.6 AND NOT (len(w) <= 2 AND COALESCE(list_contains({_LIST}, w[1]), false)) THEN NULLIF(array_to_string(list_sort(list_filter(w, lambda v: length(v) > 2 AND NOT list_contains({_LIST}, v))), ' '), '') END"""
_TYPO = f"regexp_matches(regexp_replace(phrase, '(^| ){salience.CONSONANTS}+', '\\1', 'g'), '{salience.CONSONANTS}{{4}}')"
_CONCEPTS = rf"""{_GRAMS}, {_TOPICS}, u AS (SELECT topic_id, src_idx, doc_id, unnest(range(len(words))) AS pos, unnest(words) AS w FROM tok), m AS (SELECT *, regexp_matches(w, '{NOUN}') AS noun FROM u WHERE regexp_matches(w, '{NOUN}') OR regexp_matches(w, '{MODIFIER}')),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isle FROM m), p AS (SELECT topic_id, src_idx, doc_id, isle, string_agg(w, ' ' ORDER BY pos) AS phrase, count(*) AS n, arg_max(noun, pos) AS noun FROM i GROUP BY ALL), runs AS (SELECT topic_id, src_idx, phrase, phrase AS c, string_split(phrase, ' ') AS w FROM p WHERE n BETWEEN 2 AND 5 AND noun),
keyed AS (SELECT topic_id, src_idx, phrase, w, {_KEY} AS key FROM runs), tot AS (SELECT topic_id, key, count(*) AS freq, count(DISTINCT src_idx) AS sources, max(len(w)) AS nw FROM keyed WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
forms AS (SELECT topic_id, key, phrase, count(*) AS n FROM keyed WHERE key IS NOT NULL GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY topic_id, key ORDER BY n DESC, phrase) AS k, row_number() OVER (PARTITION BY topic_id, key ORDER BY {_TYPO}, n DESC, phrase) AS b FROM forms),
shown AS (SELECT topic_id, key, max(phrase) FILTER (b = 1) AS display, string_agg(phrase, ', ' ORDER BY phrase) FILTER (k <= 5) AS variants FROM fr GROUP BY ALL),
sc AS (SELECT topic_id, key, display, variants, CASE WHEN nw <= 2 THEN 'CONCEPT' ELSE 'TOPICAL' END AS etype, freq, sources, round(LEAST(1.0::DOUBLE, 0.35::DOUBLE * sources / n_sources + LEAST(0.25::DOUBLE, 0.06::DOUBLE * ln(freq + 1)) + CASE nw WHEN 2 THEN 0.20::DOUBLE WHEN 3 THEN 0.18::DOUBLE WHEN 1 THEN 0.10::DOUBLE ELSE 0.08::DOUBLE END + 0.2::DOUBLE * len(list_intersect(string_split(display, ' '), {_KWORDS})) / GREATEST(len({_KWORDS}), 1)), 6) AS importance FROM tot JOIN shown USING (topic_id, key) JOIN tp USING (topic_id)),
cpt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY importance DESC, key) AS rank FROM sc) WHERE rank <= 30)"""
_HEAD_ROWS = _HEADS.strip().replace("f AS", "hf AS", 1).replace("FROM f)", "FROM hf)").replace(",\ne AS", ",\nhe AS", 1).replace("FROM e WHERE", "FROM he WHERE")
_ROLES = rf"""{_GRAMS}, {_TOPICS}, {_HEAD_ROWS}, sp AS (SELECT topic_id, src_idx, list_filter(regexp_split_to_array(content, '[.!?]+\s+'), lambda s: trim(s, ' ') <> '') AS s FROM src), se AS (SELECT topic_id, src_idx, len(s) AS n, unnest(range(len(s))) AS pos, lower(unnest(s)) AS sentence FROM sp),
ph AS (SELECT topic_id, src_idx, pos, pos / GREATEST(n, 1) AS place, sentence, array_to_string(({_WORDS.format('sentence')})[1:5], ' ') AS head, unnest({PHRASES!r}) AS phrase FROM se), mn AS (SELECT *, contains(head, phrase) AS subject FROM ph WHERE contains(sentence, phrase)),
pr AS (SELECT topic_id, phrase, src_idx, min(place) AS first, count(*) AS n, count(*) FILTER (subject) AS led, max((pos < 3)::INT) AS early FROM mn GROUP BY ALL), ag AS (SELECT topic_id, phrase, avg(first) AS position, sum(n)::BIGINT AS n, sum(led)::BIGINT AS led, sum(early)::BIGINT AS early, count(*) AS sources FROM pr GROUP BY ALL),
hh AS (SELECT a.topic_id, a.phrase, count(*) AS in_h1 FROM ag a JOIN heads h USING (topic_id) WHERE len(list_filter(list_transform(string_split(phrase, ' '), lambda w: CASE WHEN length(w) > 5 THEN substring(w, 1, length(w) - 3) ELSE w END), lambda s: len(list_filter({_WORDS.format('lower(h.heading)')}, lambda x: starts_with(x, s))) = 0)) = 0 GROUP BY ALL),
sr AS (SELECT topic_id, phrase, round(position, 6) AS position, early, round(led / n, 6) AS subject_ratio, COALESCE(in_h1, 0) AS in_h1, 0::BIGINT AS in_h2, round(LEAST(1.0::DOUBLE, 0.25::DOUBLE * (1 - position) + CASE WHEN in_h1 > 0 THEN 0.15::DOUBLE ELSE 0 END + 0.15::DOUBLE * led / n + 0.2::DOUBLE * (sources / n_sources) + CASE WHEN sources / n_sources < 0.5 THEN LEAST(0.05::DOUBLE, -0.02::DOUBLE * ln(sources / n_sources + 0.01::DOUBLE)) ELSE 0 END + 0.1::DOUBLE * LEAST(1.0::DOUBLE, early / n_sources) + CASE WHEN list_has_any(string_split(phrase, ' '), string_split(keyword, ' ')) THEN 0.05::DOUBLE ELSE 0 END), 6) AS salience FROM ag LEFT JOIN hh USING (topic_id, phrase) JOIN tp USING (topic_id)),
roles AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY salience DESC, phrase) AS rank FROM sr)"""


def _relations() -> str:
    each = " UNION ALL ".join(f"SELECT lang AS topic_id, '{k}' AS relation, unnest(regexp_extract_all(text, '{p}', 1)) AS a, unnest(regexp_extract_all(text, '{p}', 2)) AS b FROM documents" for k, p in RELATIONS)
    named = " OR ".join(f"contains(subject || ' | ' || object, '{e}')" for e in PHRASES if len(e) > 4)
    return rf"""WITH x AS ({each}), c AS (SELECT topic_id, relation, substring(trim(lower(a), ' '), 1, 50) AS subject, substring(trim(lower(b), ' '), 1, 50) AS object, count(*) AS n FROM x GROUP BY ALL), w AS (SELECT lang AS topic_id, unnest(regexp_extract_all(lower(text), '\p{{L}}{{5,}}')) AS w FROM documents), wc AS (SELECT topic_id, w, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2),
o AS (SELECT topic_id, list(w) AS often FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, w) AS k FROM wc) WHERE k <= 50 GROUP BY 1), kept AS (SELECT c.* FROM c LEFT JOIN o USING (topic_id) WHERE length(subject) > 2 AND length(object) > 2 AND ({named} OR len(list_filter(COALESCE(often, []), lambda v: contains(subject || ' | ' || object, v))) > 0))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, relation, subject, object) AS rank FROM kept) WHERE rank <= 20"""


TWINS = {
    "f9_topical_entities": f"WITH {_CONCEPTS} SELECT topic_id, rank, key, display, variants, etype, freq, sources, importance FROM cpt",
    "f11_salience_topical": rf"""WITH {_CONCEPTS}, {_HEAD_ROWS}, con AS (SELECT * FROM cpt WHERE length(display) >= 3 AND len(list_filter(string_split(display, ' '), lambda w: NOT list_contains({NAV!r}, w))) > 0), pl AS (SELECT topic_id, display, src_idx, min((strpos(lower(content), display) - 1) / GREATEST(length(content), 1)) AS first, max((strpos(lower(content), display) - 1 < 1500)::INT) AS early FROM con JOIN src USING (topic_id) WHERE length(content) >= 100 AND contains(lower(content), display) GROUP BY ALL),
po AS (SELECT topic_id, display, list(first ORDER BY src_idx) AS firsts, sum(early)::BIGINT AS early FROM pl GROUP BY ALL), pa AS (SELECT topic_id, display, list_reduce([1.0::DOUBLE] || firsts, lambda a, x: (a * (sources - 1) + x) / sources) AS position, early FROM po JOIN con USING (topic_id, display)), ph AS (SELECT topic_id, display, count(*) AS in_h1 FROM con JOIN heads USING (topic_id) WHERE contains(lower(heading), display) GROUP BY ALL),
z AS (SELECT topic_id, display, sources, n_sources, keyword, COALESCE(position, 1.0) AS position, COALESCE(early, 0) AS early, COALESCE(in_h1, 0) AS in_h1, 0::BIGINT AS in_h2 FROM con LEFT JOIN pa USING (topic_id, display) LEFT JOIN ph USING (topic_id, display) JOIN tp USING (topic_id)),
y AS (SELECT topic_id, display, round(position, 6) AS position, early, in_h1, in_h2, round(LEAST(1.0::DOUBLE, 0.25::DOUBLE * sources / n_sources + 0.2::DOUBLE * (1 - position) + 0.15::DOUBLE * LEAST(1.0::DOUBLE, early / n_sources) + 0.15::DOUBLE * LEAST(1.0::DOUBLE, in_h1 / n_sources) + 0.1::DOUBLE * LEAST(1.0::DOUBLE, len(list_intersect(string_split(display, ' '), string_split(keyword, ' '))) / len(string_split(keyword, ' ')))), 6) AS salience FROM z) SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY salience DESC, display) AS rank FROM y""",
    "f12_salience_roles": f"WITH {_ROLES} SELECT topic_id, phrase, position, early, subject_ratio, in_h1, in_h2, salience, rank FROM roles",
    "f15_extract_relations": _relations(),
    "f16_main_entity": f"WITH {_ROLES}, ent AS ({_BASE['f2_entity_stats']}), un AS (SELECT topic_id, phrase, 0 AS kind, rank FROM roles UNION ALL SELECT topic_id, phrase, 1, rank FROM ent), ok AS (SELECT * FROM ({_reason('phrase', 'un', 'topic_id, phrase, kind, rank')}) WHERE reason IS NULL), fi AS (SELECT topic_id, arg_min(phrase, kind * 1000 + rank) AS phrase FROM ok WHERE len(string_split(phrase, ' ')) <= 4 GROUP BY 1), "
    "og AS (SELECT k.topic_id, keyword, phrase, CASE WHEN phrase IS NULL THEN 'keyword only' WHEN contains(keyword, phrase) OR list_has_any(string_split(keyword, ' '), string_split(phrase, ' ')) THEN 'keyword holds it' WHEN NOT EXISTS (SELECT 1 FROM heads h WHERE h.topic_id = k.topic_id AND contains(lower(heading), phrase)) THEN 'in no heading' ELSE 'phrase' END AS origin FROM tp k LEFT JOIN fi USING (topic_id)) SELECT topic_id, CASE WHEN origin = 'phrase' THEN phrase ELSE keyword END AS entity, origin FROM og",
    "f19_early_entities": f"WITH {_ROLES}, c AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY salience DESC, phrase) AS r FROM roles WHERE 1 - position >= 0.8 OR early >= 3) SELECT topic_id, r AS rank, phrase, CASE WHEN subject_ratio > 0 THEN floor(100 * subject_ratio)::BIGINT ELSE 70 END AS subject_pct FROM c WHERE r <= 6",
    "f21_match_brands": f"WITH b AS (SELECT conv_id::VARCHAR AS topic_id, lower(text) AS low, unnest({[b.lower() for b in BRANDS]!r}) AS brand FROM conversations) SELECT DISTINCT topic_id, brand FROM b WHERE contains(low, brand)",
}
