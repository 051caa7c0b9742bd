"""Fixes, issues, references, clusters and budgets over the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import topic as T
from textloom.functions.lists import FACTS, STOP
from textloom.operators import articles as A
from textloom.operators import checks, editing, facts, gaps, meaning
from textloom.plans import tables as t
from textloom.plans.gaps import RULES, _FACTS, _facts
from textloom.plans.terms import _entities, _top
from textloom.plans.twins import _HEADS, _KEYWORDS, _WEIGHT, _WORDS, TWINS as _BASE

#: Corrections by phrase: what stands there, what is put, of which category (fixed values).
FIXES = [("the", "teh", "TYPOS"), ("of", "off", "GRAMMAR"), ("license", "licence", "STYLE"), ("and", "and so on and on", "TYPOS")]
REFERENCES = [("license", "Act 1"), ("open source license", "Act 2"), ("guide to", "Act 3"), ("der", "Act 4"), ("les", "Act 5"), ("guide", "Act 1")]
MARKS = {"law": ["license", "under the"], "safety": ["idiot", "kill"]}
TRANSLATED = [("mit license", "license granted"), ("die", "nicht wird"), ("the", "with this that")]
EVIDENCE = ["granted", "license", "with", "other"]
CORRECTIONS = [("license", "licence"), ("the ", "remove this word"), ("idiot", "person"), ("of the", "ok"), ("MIT", "M.I.T."), ("under", "change to: 'beneath it'")]
VARIANTS = [("en", 1, "free license"), ("en", 2, "own"), ("de", 1, "freie lizenz"), ("fr", 11, "licence libre")]


def i3_apply_offset_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each listed word is a fix; its sentence is the text."""
    docs = t.docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    place = lambda w: F.regexp_instr("text", F.lit(rf"\b{w}\b")) - 1
    each = F.array(*[F.struct(place(w).alias("place"), F.lit(len(w)).alias("length"), F.lit(c).alias("category"), F.array(F.lit(n)).alias("replacements")) for w, n, c in FIXES])
    fixes = docs.select("doc_id", F.col("text").alias("sentence"), F.explode(F.filter(each, lambda f: f["place"] >= 0)).alias("f")).select("doc_id", "sentence", "f.*")
    return editing.apply_offset_fixes(docs, fixes).select("doc_id", "applied", F.md5("text").alias("digest"))


def i5_collect_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden phrases, bold spans, openers and banned characters of each article as one table."""
    rows = A.prepared(t.docs(spark, sf_dir))
    held = lambda words, test: F.filter(F.array(*[F.lit(w) for w in words]), test)
    lists = {"phrases": held(T.FORBIDDEN, lambda w: F.contains("low", w)), "spans": A.bold_spans(F.col("body")), "openers": held(T.OPENERS, lambda o: F.exists("sents", lambda s: F.trim(s).startswith(o))), "chars": held(["%", "$", "#", "|"], lambda c: F.contains("body", c))}
    return editing.collect_issues(rows.withColumns(lists), {"phrases": "high", "spans": "low", "openers": "medium", "chars": "medium"})


def i7_protected_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = t.topics(spark, sf_dir).select("topic_id", F.col("keyword").alias("phrase")).unionByName(_entities(spark, sf_dir).filter("rank = 1").select("topic_id", "phrase"))
    variants = spark.createDataFrame(VARIANTS, "topic_id string, rank int, phrase string")
    return editing.protected_phrases(named, _top(spark, sf_dir).select("topic_id", "rank", F.col("gram").alias("phrase")), variants)


def i8_reference_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = facts.hard_facts(t.docs(spark, sf_dir), FACTS).select(F.col("lang").alias("topic_id"), "rank", F.concat_ws(": ", "kind", "value").alias("text"))
    path = lambda rows: rows.select("topic_id", F.concat_ws(" ", "subject", "predicate", "object").alias("text")).distinct()
    found = gaps.normalise_facts(_facts(spark, sf_dir))
    triples, causal = (editing.ranked(path(found.filter(F.col("ttype") == k)), 15, F.asc("text")) for k in ("eav", "spo"))
    lines = t.docs(spark, sf_dir).select(F.col("lang").alias("topic_id"), F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") <= 200)
    return t.long(editing.reference_facts(hard, triples, causal, lines, MARKS), "rank")


def h13_match_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = editing.match_references(F.col("heading"), REFERENCES)
    return t.headings(spark, sf_dir).select("page_id", "pos", F.array_join(acts, ", ").alias("acts"))


def h15_relevant_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = t.docs(spark, sf_dir).select(F.col("lang").alias("topic_id"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    topics = t.topics(spark, sf_dir)
    return t.long(editing.relevant_publications(pubs, topics, TRANSLATED, EVIDENCE, small=t.few_topics(topics)), "rank")


def h8_entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a lower threshold than usual, as the given vectors lie far apart."""
    return meaning.entity_clusters(t.table(spark, sf_dir, "embeddings"), threshold=0.25, strong=0.3)


def h9_rank_headings_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a label's vectors by id the first is the keyword, five are questions, twenty are competitors' headings; all are candidates."""
    rows = t.table(spark, sf_dir, "embeddings").select(F.col("label").alias("topic_id"), F.col("vec_id").alias("id"), "embedding")
    first = meaning.ranked(rows, 26, F.asc("id")).withColumn("kind", F.when(F.col("rank") == 1, "keyword").when(F.col("rank") <= 6, "question").otherwise("heading"))
    k = F.col("rank") - F.when(F.col("rank") == 1, 1).when(F.col("rank") <= 6, 2).otherwise(7)
    return t.long(meaning.rank_headings_semantic(rows, first.withColumn("k", k).select("topic_id", "kind", "k", "embedding")), "rank")


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(a).alias("original"), F.lit(b).alias("replacement")) for k, (a, b) in enumerate(CORRECTIONS)])
    return t.docs(spark, sf_dir).select("doc_id", F.explode(listed).alias("c")).select("doc_id", "c.*")


def i1_flag_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as replacements."""
    return checks.flag_instructions(t.table(spark, sf_dir, "conversations").withColumn("replacement", F.col("text"))).select("conv_id", "turn", "is_instruction")


def i2_apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = checks.apply_corrections(docs, checks.flag_instructions(_corrections(spark, sf_dir)))
    return rows.select("doc_id", "applied", "flagged", F.array_join("reasons", ",").alias("reasons"), F.md5("text").alias("digest"))


def g2_parse_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's triplets are written as a JSON array in a fence, every other one cut off, and read back."""
    rows = _facts(spark, sf_dir).select("topic_id", "doc_id", F.struct("subject", "predicate", "object").alias("t"), "pos").filter("pos < 3")
    whole = rows.groupBy("topic_id", "doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"])).alias("j"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), F.col("j"), F.lit("\n```"))).otherwise(F.concat(F.lit("```json\n"), F.expr("substring(j, 1, length(j) - 3)")))
    return gaps.parse_triplets(whole.select("topic_id", "doc_id", text.alias("payload")), "subject string, predicate string, object string", "payload")


def _causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence openings as causes, the words after them as effects."""
    rows = _facts(spark, sf_dir)
    return rows.select("topic_id", F.concat_ws(" ", "subject", "predicate").alias("cause"), F.concat_ws(" ", "predicate", "object").alias("effect"), F.when(F.col("ttype") == "eav", "prevents").otherwise("other").alias("relation"), "confidence")


def g3_normalise_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.normalise_causal(_causal(spark, sf_dir)).distinct()


def g5_mark_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.long(facts.mark_chains(facts.different_links(facts.normalise_causal(_causal(spark, sf_dir)))), "rank")


def g7_key_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.key_path(g5_mark_chains(spark, sf_dir))


def l1_parse_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget lines written from documents: their first word with a range, a single number or nothing."""
    word = F.regexp_extract(F.lower("text"), r"(\p{L}+)", 1)
    n = F.length("text") % 7 + 1
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(word, F.lit(": "), n.cast("string"), F.lit(" - "), (n + 3).cast("string"), F.lit("x"))).when(F.col("doc_id") % 3 == 1, F.concat(word, F.lit(" : "), n.cast("string"))).otherwise(word)
    return t.long(facts.parse_budgets(t.docs(spark, sf_dir).select(F.col("lang").alias("topic_id"), F.col("doc_id").alias("pos"), line.alias("line"))), "low", "high")


QUERIES = [i3_apply_offset_fixes, i5_collect_issues, i7_protected_phrases, i8_reference_facts, h13_match_references, h15_relevant_publications, h8_entity_clusters, h9_rank_headings_semantic, i1_flag_instructions, i2_apply_corrections, g2_parse_triplets, g3_normalise_causal, g5_mark_chains, g7_key_path, l1_parse_budgets]

_TOPS = f"tops AS (SELECT topic_id, gram, rank FROM (WITH {_WEIGHT} SELECT * FROM topped) WHERE rank <= 30)"


def _acts() -> str:
    low = "lower(trim(heading, ' '))"
    longer = lambda x: rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]{{3,}}')"
    rows = "[" + ", ".join(f"CASE WHEN contains({low}, '{p}') OR contains('{p}', {low}) THEN '{a}' END" for p, a in REFERENCES) + "]"
    loose = "[" + ", ".join(f"CASE WHEN list_has_any({longer(low)}, {longer(repr(p))}) THEN '{a}' END" for p, a in REFERENCES) + "]"
    first = lambda x: f"list_filter({x}, lambda v, i: v IS NOT NULL AND list_position({x}, v) = i)[1:6]"
    return f"WITH {_HEADS} SELECT page_id, pos, array_to_string(CASE WHEN len({first(rows)}) > 0 THEN {first(rows)} ELSE {first(loose)} END, ', ') AS acts FROM heads WHERE heading <> ''"


def _publications() -> str:
    turned = "keyword"
    for a, b in sorted(TRANSLATED, key=lambda x: (-len(x[0]), x[0])):
        turned = f"replace({turned}, '{a}', '{b}')"
    longer = lambda x: f"list_filter(string_split({x}, ' '), lambda w: length(w) > 3)"
    level = "CASE " + " ".join(f"WHEN contains(low, '{e}') THEN {k}" for k, e in enumerate(EVIDENCE[:-1])) + f" ELSE {len(EVIDENCE) - 1} END"
    return f"""WITH {_KEYWORDS}, d AS (SELECT lang AS topic_id, doc_id AS id, lower(text) AS low, {longer('keyword')} AS own, {longer(turned)} AS words FROM documents JOIN kw ON kw.topic_id = lang), f AS (SELECT topic_id, id, low, len(words) AS n, len(list_filter(words, lambda w: contains(low, w))) AS fw, len(list_filter(own, lambda w: contains(low, w))) AS fo FROM d),
r AS (SELECT topic_id, id, {level} AS level, round(fw / GREATEST(n, 1), 4) AS share FROM f WHERE (fw > 0 OR fo > 0) AND (n < 2 OR fw / GREATEST(n, 1) >= 0.3)), k AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY level, share DESC, id) AS rank FROM r) SELECT topic_id, rank, id, {EVIDENCE!r}[level + 1] AS evidence, share FROM k WHERE rank <= 20"""


def _issues() -> str:
    phrases = " UNION ALL ".join(f"SELECT doc_id, 'phrases' AS kind, 'high' AS severity, '{p}' AS text FROM documents WHERE contains(lower(text), '{p}')" for p in T.FORBIDDEN)
    openers = " UNION ALL ".join(rf"SELECT doc_id, 'openers', 'medium', '{o}' FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[.!?]+\s+'), lambda s: starts_with(trim(s, ' '), '{o}'))) > 0" for o in T.OPENERS)
    chars = " UNION ALL ".join(f"SELECT doc_id, 'chars', 'medium', '{c}' FROM documents WHERE contains(text, '{c}')" for c in "%$#|")
    return rf"{phrases} UNION ALL {openers} UNION ALL {chars} UNION ALL SELECT doc_id, 'spans', 'low', unnest(regexp_extract_all(regexp_replace(text, '(?m)^#.*$', '', 'g'), '\*\*[^*\n]+\*\*|<strong>[^<]*</strong>')) FROM documents"


def _marked() -> str:
    each = " UNION ALL ".join(f"SELECT topic_id, '{k}' AS kind, line AS text FROM ln WHERE " + " OR ".join(f"contains(lower(line), '{x}')" for x in xs) for k, xs in MARKS.items())
    return rf"""WITH {_FACTS}, hf AS ({_BASE['h11_hard_facts']}), ln AS (SELECT lang AS topic_id, unnest(string_split(text, chr(10))) AS line FROM documents), mk AS (SELECT DISTINCT * FROM ({each.replace('FROM ln WHERE ', 'FROM ln WHERE length(line) <= 200 AND (').replace(' UNION ALL ', ') UNION ALL ')})))
SELECT topic_id, kind, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, kind ORDER BY text) AS rank FROM mk) WHERE rank <= 10 UNION ALL SELECT lang, 'fact', rank, kind || ': ' || value FROM hf WHERE rank <= 20
UNION ALL SELECT topic_id, CASE ttype WHEN 'eav' THEN 'triple' ELSE 'causal' END, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, ttype ORDER BY text) AS rank FROM (SELECT DISTINCT topic_id, ttype, subject || ' ' || predicate || ' ' || object AS text FROM facts)) WHERE rank <= CASE ttype WHEN 'eav' THEN 15 ELSE 10 END"""


_CAUSAL = _FACTS.replace("AND length(w[1]) >= 2 AND length(w[3]) >= 2", "") + ", cs AS (SELECT DISTINCT topic_id, substring(subject || ' ' || predicate, 1, 80) AS cause, substring(predicate || ' ' || object, 1, 80) AS effect, CASE ttype WHEN 'eav' THEN 'prevents' ELSE 'causes' END AS relation, confidence FROM (SELECT DISTINCT topic_id, subject, predicate, object, ttype, confidence FROM facts))"
TWINS = {
    "i5_collect_issues": _issues(),
    "i7_protected_phrases": f"WITH {_TOPS}, ent AS ({_BASE['f2_entity_stats']}), {_KEYWORDS} SELECT topic_id, keyword AS phrase FROM kw JOIN (SELECT DISTINCT lang AS topic_id FROM documents) USING (topic_id) UNION SELECT topic_id, phrase FROM ent WHERE rank = 1 UNION SELECT topic_id, gram FROM tops WHERE rank <= 15 AND length(gram) > 3 UNION SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{p}')" for a, k, p in VARIANTS if k <= 10 and len(p) > 3) + ")",
    "i8_reference_facts": _marked(),
    "h13_match_references": _acts(),
    "h15_relevant_publications": _publications(),
    "h9_rank_headings_semantic": "WITH r AS (SELECT label AS topic_id, vec_id AS id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), p AS (SELECT a.topic_id, a.id, b.k, list_cosine_similarity(a.e, b.e) AS sim FROM r a JOIN r b ON a.topic_id = b.topic_id AND b.k <= 26), "
    "s AS (SELECT topic_id, id, max(sim) FILTER (k = 1) AS kw, COALESCE(max(sim) FILTER (k BETWEEN 2 AND 6), 0) AS qs, count(*) FILTER (k > 6 AND sim > 0.75) / GREATEST(count(*) FILTER (k > 6), 1) AS cv FROM p GROUP BY ALL), c AS (SELECT topic_id, id, round(0.5::DOUBLE * kw + 0.3::DOUBLE * qs + 0.2::DOUBLE * cv, 4) AS score, round(kw, 4) AS keyword, round(qs, 4) AS question, round(cv, 4) AS coverage FROM s) "
    "SELECT * FROM (SELECT *, CASE WHEN score >= 0.65 THEN 'must' WHEN score >= 0.5 THEN 'high' ELSE 'optional' END AS priority, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= 10",
    "i1_flag_instructions": r"WITH c AS (SELECT conv_id, turn, COALESCE(text, '') AS t, lower(trim(COALESCE(text, ''), ' ')) AS low FROM conversations) SELECT conv_id, turn, length(t) <= 5 OR regexp_matches(low, '^(?:remove|rephrase|consider|change|delete|replace|check|make sure)') OR (contains(low, 'remove') AND (contains(low, ':') OR contains(low, 'or '))) OR contains(low, ': ''') OR contains(low, ':" + '"' + r"') OR (length(low) > 200 AND regexp_matches(low, 'remove|replace')) AS is_instruction FROM c",
    "g2_parse_triplets": _FACTS.join(["WITH ", ", raw AS (SELECT lang AS topic_id, doc_id, w[1] AS subject, w[2] AS predicate, w[3] AS object, pos FROM fw WHERE len(w) >= 3 AND pos < 3) SELECT topic_id, doc_id, subject, predicate, object FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back FROM raw) WHERE doc_id % 2 = 0 OR back > 1"]),
    "g3_normalise_causal": f"WITH {_CAUSAL} SELECT * FROM cs WHERE length(cause) >= 3 AND length(effect) >= 3",
    "g5_mark_chains": f"WITH {_CAUSAL}, ok AS (SELECT *, array_to_string(string_split(lower(cause), ' ')[1:3], ' ') AS kc, array_to_string(string_split(lower(effect), ' ')[1:3], ' ') AS ke FROM cs WHERE length(cause) >= 3 AND length(effect) >= 3), ch AS (SELECT topic_id, cause, effect, relation, confidence, EXISTS (SELECT 1 FROM ok b WHERE b.topic_id = a.topic_id AND b.ke = a.kc) OR EXISTS (SELECT 1 FROM ok b WHERE b.topic_id = a.topic_id AND b.kc = a.ke) AS is_chain FROM ok a) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY is_chain DESC, confidence DESC, cause, effect, relation) AS rank FROM ch) WHERE rank <= 15",
    "l1_parse_budgets": r"WITH b AS (SELECT lang AS topic_id, doc_id, regexp_extract(lower(text), '(\p{L}+)', 1) AS phrase, length(text) % 7 + 1 AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, phrase ORDER BY doc_id DESC) AS k FROM b WHERE phrase <> '') SELECT topic_id, phrase, CASE doc_id % 3 WHEN 0 THEN n ELSE 1 END::BIGINT AS low, CASE doc_id % 3 WHEN 0 THEN n + 3 WHEN 1 THEN n ELSE 99 END::BIGINT AS high FROM r WHERE k = 1",
}
TWINS["g7_key_path"] = f"SELECT topic_id, cause || CASE WHEN relation NOT IN ('causes', 'leads_to', '') THEN ' → ' || relation ELSE '' END || ' → ' || effect AS path FROM ({TWINS['g5_mark_chains']}) WHERE rank = 1"
