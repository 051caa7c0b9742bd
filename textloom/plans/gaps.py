"""Gaps, plans, triplets, issues and page text over the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.lists import LEXICON, STOP
from textloom.operators import checks, gaps, grams, headings, text
from textloom.plans import tables as t
from textloom.plans.twins import _GRAMS, _HEADS, _LIST, _WORDS, NAV_LINES, TWINS as _BASE, _main_text

CLASSES = {"legal": ["license", "law", "the"], "health": ["heal", "doc"], "plain": ["th", "re", "la"]}
RULES = [("of the", "style"), ("idiot", "tone"), ("license", "terms"), ("the the", "grammar"), ("worthless", "tone")]
SEVERITY = {"grammar": 1, "tone": 2, "style": 3}
#: Phrases and the most uses that count.
MATCHED = [("the license", 3), ("than the words", 4), ("is licensed under", 2), ("license", 5), ("of the and", 6)]
SEQUENCES = ["the", "than the", "is licensed under"]
#: Words that begin a question that can be answered by yes or no.
LEADS = ["is", "are", "does", "the", "ist", "est"]
DEFAULTS = ["what it is", "how it works", "costs", "questions"]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users write, as questions on the topic ``en``."""
    rows = t.table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select(F.lit("en").alias("topic_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))


def _unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = grams.tokens(text.documents_as_sources(t.docs(spark, sf_dir)))
    return gaps.gap_unanswered(_questions(spark, sf_dir), t.headings(spark, sf_dir), tokens, STOP)


def h1_gap_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unanswered(spark, sf_dir)


def h2_gap_subtopic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_subtopic(_questions(spark, sf_dir), t.headings(spark, sf_dir), "open license", STOP)


def h4_merge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that texts do not answer, and those that no heading covers."""
    asked = _questions(spark, sf_dir)
    open_ones = _unanswered(spark, sf_dir).join(asked, ["topic_id", "id"]).select("topic_id", "id", F.lit("unanswered").alias("kind"), "question", "priority")
    bare = h2_gap_subtopic(spark, sf_dir).join(asked, ["topic_id", "id"]).select("topic_id", "id", F.lit("subtopic").alias("kind"), "question", F.lit("medium").alias("priority"))
    return t.long(gaps.merge_gaps(open_ones.unionByName(bare), STOP, leads=LEADS), "rank")


def h7_semantic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.semantic_gaps(t.table(spark, sf_dir, "embeddings"))


def h12_topic_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.headings(spark, sf_dir).select("page_id", "pos", gaps.topic_class(F.col("heading"), CLASSES).alias("c"))
    return rows.select("page_id", "pos", "c.class", "c.confidence")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word sentence openings as triplets; the number of words stands for a confidence."""
    rows = checks.sentences(t.docs(spark, sf_dir).select("doc_id", "lang", "text").withColumn("__k", F.struct("doc_id", "lang")), key="__k")
    w = headings.words_of(F.col("sentence"))
    rows = rows.select(F.col("__k.lang").alias("topic_id"), F.col("__k.doc_id").alias("doc_id"), "pos", w.alias("w")).filter("size(w) >= 3")
    return rows.select("topic_id", "doc_id", F.col("pos").cast("long").alias("pos"), F.get("w", F.lit(0)).alias("subject"), F.get("w", F.lit(1)).alias("predicate"), F.get("w", F.lit(2)).alias("object"), F.when(F.size("w") > 8, "eav").otherwise("other").alias("ttype"), F.lit("misc").alias("category"), (F.size("w") / 10).alias("confidence"))


def g4_normalise_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.normalise_facts(_facts(spark, sf_dir))


def g6_triplet_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps.drop_shop_triplets(gaps.normalise_facts(_facts(spark, sf_dir)), "shop|the ")
    return rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))


def g7_key_triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.key_triplet(gaps.normalise_facts(_facts(spark, sf_dir)))


def e6_heading_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.long(gaps.heading_plan(headings.topical_coverage(t.headings(spark, sf_dir)), DEFAULTS), "rank")


def i4_rank_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.rank_issues(t.docs(spark, sf_dir), RULES, SEVERITY, ["worthless"])


def i4_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.issue_counts(t.docs(spark, sf_dir), RULES, ["worthless"])


def i10_fallback_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.fallback_variants(t.headings(spark, sf_dir)).select("page_id", "pos", "variant")


def l2_sequence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.sequence_hits(grams.tokens(text.documents_as_sources(t.docs(spark, sf_dir))), SEQUENCES)


def l2_lemma_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.lemma_matches(grams.tokens(text.documents_as_sources(t.docs(spark, sf_dir))), MATCHED, dict(LEXICON))


def b3_crosscheck_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of a text stands for the second extraction."""
    rows = t.docs(spark, sf_dir).withColumn("second", F.expr("substring(text, cast(length(text) div 2 as int) + 1)"))
    return rows.select("doc_id", F.md5(gaps.crosscheck_lines(rows, "text", "second")).alias("digest"))


def b10_best_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.best_text(t.table(spark, sf_dir, "pages"), NAV_LINES, STOP)


def a2_flatten_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.flatten_payload(t.table(spark, sf_dir, "events"))


def a2_flatten_serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a search payload: answers are results, questions are questions, the first turn the answer box, the second the overview."""
    turn = F.struct("turn", "role", "text")
    rows = t.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("x"))
    of = lambda role: F.filter("x", lambda r: r["role"] == role)
    text = lambda k: F.get("x", F.lit(k))["text"]
    payload = F.to_json(F.struct(
        F.transform(of("assistant"), lambda r: F.struct(F.substring(r["text"], 1, 40).alias("title"), r["text"].alias("snippet"))).alias("organic_results"),
        F.transform(of("user"), lambda r: F.struct(r["text"].alias("question"))).alias("related_questions"),
        F.struct(F.substring(text(0), 1, 10).alias("title"), text(0).alias("snippet")).alias("answer_box"),
        F.struct(text(1).alias("text")).alias("ai_overview"),
        F.transform("x", lambda r: F.struct(F.substring(r["text"], 1, 20).alias("query"))).alias("related_searches"),
    ))
    return gaps.flatten_serp(rows.select(F.col("conv_id").cast("string").alias("topic_id"), payload.alias("payload"))).select("topic_id", "kind", "pos", F.md5("text").alias("text"), F.md5(F.coalesce("answer", F.lit(""))).alias("answer"))


def a7_competitor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.table(spark, sf_dir, "pages").withColumn("topic_id", F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})(?:/|$)", 1))
    return t.long(gaps.competitor_table(pages), "rank")


QUERIES = [h1_gap_unanswered, h2_gap_subtopic, h4_merge_gaps, h7_semantic_gaps, h12_topic_class, g4_normalise_facts, g6_triplet_quality, g7_key_triplet, e6_heading_plan, i4_rank_issues, i4_issue_counts, i10_fallback_variants, l2_sequence_hits, l2_lemma_matches, b3_crosscheck_lines, b10_best_text, a2_flatten_payload, a2_flatten_serp, a7_competitor_table]


def _content(x: str) -> str:
    return rf"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '\p{{L}}{{4,}}'), lambda w: NOT list_contains({_LIST}, w))))"


_ASKED = rf"""{_HEADS}, qs AS (SELECT 'en' AS topic_id, conv_id * 1000 + turn AS id, text AS question, {_content('text')} AS words FROM conversations WHERE role = 'user'),
hw AS (SELECT topic_id, {_content('heading')} AS hw FROM heads), bare AS (SELECT * FROM qs WHERE len(words) >= 2 AND NOT EXISTS (SELECT 1 FROM hw WHERE hw.topic_id = qs.topic_id AND len(list_intersect(hw.hw, qs.words)) >= 2))"""
_OPEN = rf"""{_ASKED}, kn AS (SELECT DISTINCT lang AS topic_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents), ask AS (SELECT topic_id, id, unnest(words) AS word FROM bare WHERE length(question) >= 10),
un AS (SELECT a.topic_id, id, round(avg(CASE WHEN kn.word IS NULL THEN 0 ELSE 1 END), 6) AS share FROM ask a LEFT JOIN kn ON a.topic_id = kn.topic_id AND a.word = kn.word GROUP BY ALL), gap AS (SELECT *, CASE WHEN share < 0.6 THEN 'high' ELSE 'medium' END AS priority FROM un WHERE share < 0.8)"""
_FACTS = rf"""parts AS (SELECT doc_id, lang, regexp_split_to_array(text, '[.!?]+\s+') AS a FROM documents), q AS (SELECT doc_id, lang, unnest(range(len(a))) AS pos, unnest(a) AS s FROM parts), fw AS (SELECT *, {_WORDS.format('s')} AS w FROM q WHERE trim(s, ' ') <> ''),
facts AS (SELECT lang AS topic_id, doc_id, pos, w[1] AS subject, w[2] AS predicate, w[3] AS object, CASE WHEN len(w) > 8 THEN 'eav' ELSE 'spo' END AS ttype, 'property' AS category, GREATEST(0.3::DOUBLE, LEAST(0.95::DOUBLE, len(w) / 10)) AS confidence FROM fw WHERE len(w) >= 3 AND length(w[1]) >= 2 AND length(w[3]) >= 2)"""


def _classes() -> str:
    scores = [(c, " + ".join(f"contains(lower(heading), '{x}')::INT" for x in xs)) for c, xs in CLASSES.items()]
    names = ", ".join(f"{s} AS h{k}" for k, (_, s) in enumerate(scores))
    top = f"GREATEST({', '.join(f'h{k}' for k in range(len(scores)))})"
    return f"WITH {_HEADS}, h AS (SELECT page_id, pos, {names} FROM heads) SELECT page_id, pos, CASE WHEN {top} = 0 THEN NULL " + " ".join(f"WHEN h{k} = {top} THEN '{c}'" for k, (c, _) in enumerate(scores)) + f" END AS class, CASE WHEN {top} > 0 THEN round(LEAST(1.0::DOUBLE, {top} / 3), 4) END AS confidence FROM h"


def _ranked_issues() -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, '{c}' AS category, {SEVERITY.get(c, 9)} AS s, (strpos(lower(text), '{r}') - 1)::BIGINT AS place FROM documents WHERE contains(lower(text), '{r}')" for r, c in RULES if r != "worthless")
    return f"SELECT doc_id, rule, category, place, row_number() OVER (PARTITION BY doc_id ORDER BY s, place, rule) AS rank FROM ({rows})"


def _sequences() -> str:
    each = []
    for p in SEQUENCES:
        w = p.split()
        each.append(f"SELECT doc_id, '{p}' AS phrase, len(list_filter(range(1, len(words) - {len(w) - 2}), lambda i: " + " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(w)) + ")) AS n FROM tok")
    return f"WITH {_GRAMS} SELECT * FROM ({' UNION ALL '.join(each)}) WHERE n > 0"


def _lemma_matches() -> str:
    """Windows as one number each, start and length; the greedy choice folds over them with free place and count in one number."""
    lemma = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEXICON) + " ELSE w END"
    each, known = [], dict(LEXICON)
    for phrase, most in MATCHED:
        parts = [known.get(w, w) for w in phrase.split()]
        k, asked = len(parts), "[" + ", ".join(f"'{known.get(w, w)}'" for w in phrase.split()) + "]"
        holds = lambda n: f"len(list_filter({asked}, lambda w: NOT list_contains(words[i + 1:i + {n}], w))) = 0"
        case = " ".join(f"WHEN i + {n} <= len(words) AND {holds(n)} AND len(list_filter(ex, lambda s: s < i + {n} AND s + {k} > i)) = 0 THEN i * 64 + {n}" for n in range(k, k + 3))
        each.append(
            f"SELECT doc_id, '{phrase}' AS phrase, len(ex)::BIGINT AS exact, (list_reduce([0::BIGINT] || list_filter(list_transform(list_filter(range(0, len(words) - {k - 1}), lambda i: {holds(k + 2)}), lambda i: CASE {case} ELSE 0 END), lambda x: x > 0), "
            f"lambda acc, x: CASE WHEN x // 64 >= acc % 4294967296 AND acc // 4294967296 < {most} - len(ex) THEN (acc // 4294967296 + 1) * 4294967296 + x // 64 + x % 64 ELSE acc END) // 4294967296)::BIGINT AS fuzzy "
            f"FROM (SELECT doc_id, words, list_filter(range(0, len(words) - {k - 1}), lambda i: words[i + 1:i + {k}] = {asked}) AS ex FROM lem)"
        )
    return f"WITH {_GRAMS}, lem AS (SELECT doc_id, list_transform(words, lambda w: {lemma}) AS words FROM tok) SELECT * FROM ({' UNION ALL '.join(each)}) WHERE exact + fuzzy > 0"


_LONG = r"list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: length(w) > 3)"
_MAIN = f"mt AS ({_main_text()})"
TWINS = {
    "h1_gap_unanswered": f"WITH {_OPEN} SELECT * FROM gap",
    "h2_gap_subtopic": f"WITH {_ASKED} SELECT topic_id, id FROM bare WHERE length(question) >= 5 AND array_to_string(words, ' ') <> 'license open'",
    "h4_merge_gaps": rf"""WITH {_OPEN}, al AS (SELECT topic_id, id, 'unanswered' AS kind, priority FROM gap UNION ALL SELECT topic_id, id, 'subtopic', 'medium' FROM bare WHERE length(question) >= 5 AND array_to_string(words, ' ') <> 'license open'),
m AS (SELECT a.*, question, CASE priority WHEN 'high' THEN 0 ELSE 1 END AS level, array_to_string(words[1:3], ' ') AS norm FROM al a JOIN bare b USING (topic_id, id)), d AS (SELECT *, row_number() OVER (PARTITION BY topic_id, norm ORDER BY level, id, kind) AS k FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY level, id, kind) AS rank FROM d WHERE k = 1),
hf AS (SELECT *, regexp_replace(trim(regexp_replace(question, '\?+\s*$', ''), ' '), '(?i)^(?:{'|'.join(LEADS)})\s+', '') AS bare FROM r WHERE rank <= 15)
SELECT topic_id, rank, id, kind, priority, upper(bare[1]) || bare[2:] AS heading, level = 0 AND sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY topic_id ORDER BY rank) <= 3 AS suggested FROM hf""",
    "h7_semantic_gaps": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), key AS (SELECT label, embedding AS key FROM k WHERE k = 1), r AS (SELECT k.label, vec_id, embedding::DOUBLE[] AS e, list_cosine_similarity(embedding::DOUBLE[], key::DOUBLE[]) AS sim FROM k JOIN key ON k.label = key.label WHERE k.k > 1), "
    "v AS (SELECT a.label, a.vec_id, avg(CASE WHEN list_cosine_similarity(a.e, b.e) > 0.55 THEN 1.0 ELSE 0.0 END) AS cov FROM r a JOIN r b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.sim >= 0.15 GROUP BY ALL), s AS (SELECT r.label, r.vec_id, sim, COALESCE(cov, 0.5) AS coverage, sim * (1 - COALESCE(cov, 0.5)) AS score FROM r LEFT JOIN v ON v.label = r.label AND v.vec_id = r.vec_id WHERE sim >= 0.15), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.15) SELECT label, vec_id, round(sim, 6) AS sim, round(coverage, 6) AS coverage, round(score, 6) AS score, CASE WHEN coverage < 0.25 AND sim > 0.5 THEN 'high' WHEN coverage < 0.5 AND sim > 0.4 THEN 'medium' ELSE 'low' END AS priority, rank FROM n WHERE rank <= 15",
    "a2_flatten_serp": "WITH c AS (SELECT conv_id::VARCHAR AS topic_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, role, text) - 1 AS j FROM conversations), s AS (SELECT topic_id, 'result' AS kind, j AS pos, substring(text, 1, 40) AS text, text AS answer FROM c WHERE role = 'assistant' UNION ALL SELECT topic_id, 'question', j, text, NULL FROM c WHERE role = 'user' "
    "UNION ALL SELECT topic_id, 'query', i, substring(text, 1, 20), NULL FROM c WHERE i < 10 UNION ALL SELECT topic_id, 'answer', 0, substring(text, 1, 10), substring(text, 1, 1000) FROM c WHERE i = 0 UNION ALL SELECT topic_id, 'overview', 0, substring(text, 1, 2000), NULL FROM c WHERE i = 1) SELECT topic_id, kind, pos, md5(text) AS text, md5(COALESCE(answer, '')) AS answer FROM s WHERE text <> ''",
    "h12_topic_class": _classes(),
    "g4_normalise_facts": f"WITH {_FACTS} SELECT * FROM facts",
    "g6_triplet_quality": f"WITH {_FACTS} SELECT topic_id, count(*) AS n FROM facts WHERE NOT regexp_matches(lower(subject) || ' ' || lower(object), 'shop|the ') GROUP BY 1",
    "g7_key_triplet": f"WITH {_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY confidence DESC, subject, predicate, object) AS k FROM facts) SELECT topic_id, subject || ' → ' || predicate || ' → ' || object AS path FROM r WHERE k = 1",
    "e6_heading_plan": f"WITH p AS ({_BASE['e5_topical_coverage']}), a AS (SELECT topic_id, CASE WHEN class IN ('MUST', 'HIGH') THEN 1 ELSE 2 END AS level, rank AS k, sample AS heading FROM p UNION ALL SELECT topic_id, 3, unnest(range({len(DEFAULTS)})), unnest([{', '.join(repr(d) for d in DEFAULTS)}]) FROM (SELECT DISTINCT topic_id FROM p)), r AS (SELECT topic_id, heading, row_number() OVER (PARTITION BY topic_id ORDER BY level, k) AS rank FROM a) SELECT * FROM r WHERE rank <= 8",
    "i4_rank_issues": _ranked_issues(),
    "i4_issue_counts": f"SELECT doc_id, category, count(*) AS n FROM ({_ranked_issues()}) GROUP BY ALL",
    "i10_fallback_variants": rf"WITH {_HEADS}, l AS (SELECT page_id, pos, lower(trim(heading, ' ')) AS v FROM heads) SELECT page_id, pos, v AS variant FROM l UNION ALL SELECT page_id, pos, array_to_string(list_reverse(regexp_split_to_array(v, '\s+')), ' ') FROM l WHERE regexp_matches(v, '\s')",
    "l2_sequence_hits": _sequences(),
    "l2_lemma_matches": _lemma_matches(),
    "b3_crosscheck_lines": f"WITH d AS (SELECT doc_id, text AS a, substring(text, length(text) // 2 + 1) AS b FROM documents) SELECT doc_id, md5(CASE WHEN trim(a, ' ') = '' THEN b WHEN length(b) <= 200 THEN a ELSE array_to_string(list_filter(string_split(a, chr(10)), lambda x: length(x) >= 50 OR 2 * len(list_filter({_LONG}, lambda w: contains(lower(b), w))) >= len({_LONG})), chr(10)) END) AS digest FROM d",
    "a2_flatten_payload": "SELECT event_id, unnest(json_keys(props::JSON)) AS name, json_extract_string(props::JSON, '$.' || unnest(json_keys(props::JSON))) AS value FROM events",
    "a7_competitor_table": rf"WITH {_MAIN}, h AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})(?:/|$)', 1) AS topic_id, list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'), ' ')) AS hs FROM pages), j AS (SELECT topic_id, page_id, len({_WORDS.format('content')}) AS words, len(hs) AS n_headings, array_to_string(hs[1:12], ' | ') AS headings, substring(content, 1, 400) AS opening FROM h JOIN mt USING (page_id)), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY words DESC, page_id) AS rank FROM j) SELECT * FROM r WHERE rank <= 6",
}
