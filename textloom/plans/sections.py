"""Sections, scored headings, questions and their places over the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.lists import SHOP, STOP
from textloom.operators import entities, gaps, grams, headings, sections, text
from textloom.plans import tables as t
from textloom.plans.gaps import DEFAULTS, _ASKED, _FACTS, _OPEN, _facts, _questions, _unanswered
from textloom.plans.terms import _top
from textloom.plans.tables import ARTICLE_SQL
from textloom.plans.twins import _HEADS, _LIST, _WEIGHT, _WORDS, TWINS as _BASE

LIMITS = {"fact": 6, "triple": 6, "pair": 3}
RELATED = [("en", "license terms"), ("fr", "licence libre"), ("de", "freie lizenz")]


def j1_split_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.split_articles(t.articles(spark, sf_dir))
    return rows.select("doc_id", "part", "pos", "heading", F.md5("body").alias("digest"))


def a5_synthesize_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as titles and snippets; every third conversation is on a topic that has sources."""
    topic = F.when(F.col("conv_id") % 3 == 0, "en").otherwise(F.col("conv_id").cast("string"))
    rows = t.table(spark, sf_dir, "conversations")
    signals = rows.select(topic.alias("topic_id"), F.when(F.col("turn") % 2 == 0, "title").otherwise("snippet").alias("kind"), F.floor(F.col("turn") / 2).alias("pos"), "text")
    return sections.synthesize_sources(signals, text.documents_as_sources(t.docs(spark, sf_dir))).select("topic_id", "pos", F.md5("content").alias("digest"))


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as texts, their headings as those of competitors."""
    texts = t.articles(spark, sf_dir, F.col("lang").alias("topic_id"), F.coalesce("source", F.lit("")).alias("src"))
    heads = texts.select("topic_id", "src", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^## (.+)$"), F.lit(1))).alias("heading"))
    return sections.gap_depth(heads, texts, least=2, short=400, high=200)


def h3_gap_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depth(spark, sf_dir)


def h5_split_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn is a question, the next turn its answer."""
    answers = t.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("id"), F.col("text").alias("answer"))
    rows = _questions(spark, sf_dir).join(answers, "id", "left")
    return t.long(sections.split_questions(rows, _unanswered(spark, sf_dir), STOP), "rank")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per topic the grams of weight 0.3, the entities and the related queries."""
    strong = _top(spark, sf_dir).filter("weight >= 0.3").groupBy("topic_id").agg(F.collect_list("gram").alias("grams"))
    named = entities.entity_stats(t.mentions(spark, sf_dir, placed=False), t.topics(spark, sf_dir).drop("keyword")).filter("importance >= 0.5").groupBy("topic_id").agg(F.collect_list("phrase").alias("entities"))
    related = spark.createDataFrame(RELATED, "topic_id string, related string").groupBy("topic_id").agg(F.collect_list("related").alias("related"))
    return strong.join(named, "topic_id", "full").join(related, "topic_id", "full")


def _scored(spark: SparkSession, sf_dir: str, heads: DataFrame) -> DataFrame:
    one = headings.heading_support(heads).select("topic_id", F.lit(1).alias("pool"), F.col("rank").alias("k"), "heading", F.col("sources").alias("n"))
    asked = gaps.merge_gaps(_unanswered(spark, sf_dir).join(_questions(spark, sf_dir), ["topic_id", "id"]).withColumn("kind", F.lit("unanswered")), STOP).drop("heading").join(_questions(spark, sf_dir), ["topic_id", "id"])
    two = asked.select("topic_id", F.lit(2).alias("pool"), F.col("rank").alias("k"), F.substring("question", 1, 60).alias("heading"), F.lit(0).cast("long").alias("n"))
    three = heads.select("topic_id").distinct().select("topic_id", F.lit(3).alias("pool"), F.posexplode(F.array(*[F.lit(d) for d in DEFAULTS])).alias("k", "heading"), F.lit(0).cast("long").alias("n"))
    four = grams.ranked(_depth(spark, sf_dir), 5, F.asc("mean_words"), F.asc("heading")).select("topic_id", F.lit(4).alias("pool"), F.col("rank").alias("k"), "heading", F.lit(0).cast("long").alias("n"))
    return sections.score_headings(one.unionByName(two).unionByName(three).unionByName(four), _lists(spark, sf_dir))


def e3_score_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.long(_scored(spark, sf_dir, t.headings(spark, sf_dir)), "rank", "pool")


def e4_raw_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned headings that sources share, and for topics without any the first words of the raw ones."""
    raw = t.headings(spark, sf_dir)
    only = lambda heads: sections.score_headings(headings.heading_support(heads).select("topic_id", F.lit(1).alias("pool"), F.col("rank").alias("k"), "heading", F.col("sources").alias("n")), _lists(spark, sf_dir))
    first = raw.withColumn("heading", F.split("heading", " ")[0])
    return t.long(sections.raw_fallback(only(headings.clean_headings(raw, STOP, SHOP)), only(first)), "rank", "pool")


def e8_assign_to_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked grams make the plan; triplets of sentences are the facts, ranked entities the pairs."""
    plan = _top(spark, sf_dir).filter("rank <= 4").select("topic_id", F.col("rank").alias("section"), F.concat("gram", F.lit(" that with dans nicht")).alias("heading"))
    path = F.concat_ws(" ", "subject", "predicate", "object")
    found = gaps.normalise_facts(_facts(spark, sf_dir)).select("topic_id", F.when(F.col("ttype") == "eav", "fact").otherwise("triple").alias("kind"), path.alias("item")).distinct()
    rows = found.withColumn("k", F.lit(0)).unionByName(_top(spark, sf_dir).select("topic_id", F.lit("pair").alias("kind"), F.col("gram").alias("item"), F.col("rank").cast("int").alias("k")))
    return t.long(sections.assign_to_sections(plan, rows, LIMITS), "rank")


QUERIES = [j1_split_articles, a5_synthesize_sources, h3_gap_depth, h5_split_questions, e3_score_headings, e4_raw_fallback, e8_assign_to_sections]

_DEPTH = rf"""ar AS (SELECT doc_id, lang AS topic_id, COALESCE(source, '') AS src, {ARTICLE_SQL} AS body FROM documents),
dn AS (SELECT *, trim(regexp_replace(lower(heading), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') AS norm FROM (SELECT topic_id, src, unnest(regexp_extract_all(body, '(?m)^## (.+)$', 1)) AS heading FROM ar)),
dp AS (SELECT topic_id, norm, min(heading) AS heading, count(DISTINCT src) AS sources FROM dn WHERE norm <> '' GROUP BY ALL HAVING count(DISTINCT src) >= 2),
dl AS (SELECT doc_id, topic_id, unnest(range(len(string_split(body, chr(10))))) AS k, trim(unnest(string_split(lower(body), chr(10))), ' ') AS line FROM ar),
dm AS (SELECT doc_id, topic_id, k, length(line) AS size, line, list_distinct(regexp_extract_all(line, '\p{{L}}{{3,}}')) AS ws, len({_WORDS.format('line')}) AS n, lag(line) OVER (PARTITION BY doc_id ORDER BY k) AS last FROM dl),
df AS (SELECT m.doc_id, m.topic_id, p.norm, min(m.k) AS at FROM dm m JOIN dp p ON p.topic_id = m.topic_id AND m.size < 100 AND m.line <> '' AND len(list_intersect(ws, string_split(p.norm, ' '))) >= GREATEST(2, len(list_distinct(string_split(p.norm, ' '))) - 1) GROUP BY ALL),
ds AS (SELECT f.doc_id, f.topic_id, f.norm, f.at, min(b.k) AS rest FROM df f LEFT JOIN dm b ON b.doc_id = f.doc_id AND b.k > f.at + 2 AND b.size BETWEEN 6 AND 79 AND b.last = '' GROUP BY ALL),
dw AS (SELECT s.topic_id, s.norm, s.doc_id, COALESCE(sum(m.n) FILTER (m.k > s.at AND m.k < LEAST(COALESCE(s.rest, 1000000000), s.at + 50)), 0) AS words FROM ds s JOIN dm m ON m.doc_id = s.doc_id GROUP BY ALL),
dz AS (SELECT topic_id, norm, count(*) AS sections, avg(words) AS mean FROM dw WHERE words > 10 GROUP BY ALL),
dg AS (SELECT topic_id, heading, sources, sections, round(mean, 4) AS mean_words, CASE WHEN mean <= 200 THEN 'high' ELSE 'medium' END AS priority FROM dp JOIN dz USING (topic_id, norm) WHERE mean < 400)"""
_LISTS = "ls AS (SELECT topic_id, COALESCE(g, []) AS grams, COALESCE(n, []) AS entities, COALESCE(r, []) AS related FROM (SELECT topic_id, list(gram) AS g FROM tops WHERE weight >= 0.3 GROUP BY 1) FULL JOIN (SELECT topic_id, list(phrase) AS n FROM ent WHERE importance >= 0.5 GROUP BY 1) USING (topic_id) FULL JOIN (SELECT topic_id, list(related) AS r FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in RELATED) + ") v(topic_id, related) GROUP BY 1) USING (topic_id))"
_TOPS = f"tops AS (SELECT topic_id, gram, weight, rank FROM (WITH {_WEIGHT} SELECT * FROM topped) WHERE rank <= 30), ent AS ({_BASE['f2_entity_stats']})"


def _held(c: str) -> str:
    return f"len(list_filter(COALESCE({c}, []), lambda p: contains(low, p))) > 0"


_SCORES = f"""SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, pool, k, low) AS rank, heading, pool::BIGINT AS pool, base, boost, score, CASE WHEN score >= 0.65 THEN 'must' WHEN score >= 0.4 THEN 'high' ELSE 'optional' END AS class FROM (
SELECT topic_id, low, pool, k, CASE WHEN pool = 2 AND NOT ends_with(heading, '?') THEN heading || '?' ELSE heading END AS heading, round(b, 3) AS base, round(x, 3) AS boost, round(LEAST(1.0::DOUBLE, b + x), 3) AS score FROM (SELECT *, CASE pool WHEN 1 THEN LEAST(n * 0.11::DOUBLE, 0.88::DOUBLE) WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.35::DOUBLE ELSE 0.25::DOUBLE END AS b,
CASE WHEN {_held('grams')} THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN {_held('entities')} THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN {_held('related')} THEN 0.08::DOUBLE ELSE 0 END AS x FROM {{0}} LEFT JOIN ls USING (topic_id)))"""
_SUPPORT = "SELECT topic_id, heading, sources, rank FROM (SELECT c.*, row_number() OVER (PARTITION BY topic_id ORDER BY sources DESC, heading) AS rank FROM (SELECT topic_id, lower(heading) AS heading, count(DISTINCT src) AS sources FROM {0} GROUP BY ALL) c JOIN (SELECT topic_id, count(DISTINCT src) AS n_sources FROM {0} GROUP BY 1) USING (topic_id) WHERE sources >= CASE WHEN n_sources <= 5 THEN 2 ELSE 3 END) WHERE rank <= 40"
_MERGED = "SELECT topic_id, id, rank FROM (SELECT topic_id, id, row_number() OVER (PARTITION BY topic_id ORDER BY priority, id) AS rank FROM (SELECT g.topic_id, g.id, priority, row_number() OVER (PARTITION BY g.topic_id, array_to_string(words[1:3], ' ') ORDER BY priority, g.id) AS k FROM gap g JOIN bare b USING (topic_id, id)) WHERE k = 1) WHERE rank <= 15"
_CLEANED = f"clean AS (SELECT topic_id, src, heading FROM ({_BASE['e1_clean_headings']}))"
_MD = rf"""md AS (SELECT doc_id, {t.ARTICLE_SQL} AS body FROM documents),
ol AS (SELECT doc_id, body, trim(regexp_extract(body, '(?m)^#[ \t]+(.+)$', 1), ' ') AS h1, regexp_split_to_array(chr(10) || body, '\n##[ \t]+') AS parts FROM md),
oi AS (SELECT *, CASE WHEN h1 <> '' THEN trim(regexp_replace(parts[1], '(?s)^.*?(?:^|\n)#[ \t]+[^\n]*', ''), ' ') ELSE '' END AS intro FROM ol)"""
TWINS = {
    "j1_split_articles": rf"""WITH {_MD} SELECT doc_id, 'title' AS part, 0::BIGINT AS pos, h1 AS heading, md5('') AS digest FROM oi WHERE h1 <> '' UNION ALL SELECT doc_id, 'intro', 0, '', md5(intro) FROM oi WHERE intro <> ''
UNION ALL SELECT doc_id, 'section', i, trim(regexp_extract(s, '^([^\n]*)', 1), ' '), md5(trim(regexp_replace(s, '^[^\n]*', ''), ' ')) FROM (SELECT doc_id, unnest(range(len(parts) - 1)) AS i, unnest(parts[2:]) AS s FROM oi)
UNION ALL SELECT doc_id, 'paragraph', i, '', md5(p) FROM (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(body, '\n\s*\n'), lambda p: trim(p, ' ')), lambda p: p <> '' AND NOT starts_with(p, '## ') AND NOT regexp_matches(p, '^#[ \t][^\n]*$')) AS ps FROM oi))""",
    "a5_synthesize_sources": "WITH s AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'en' ELSE conv_id::VARCHAR END AS topic_id, turn, turn // 2 AS pos, text FROM conversations), p AS (SELECT topic_id, pos, COALESCE(max(text) FILTER (turn % 2 = 0), '') || '. ' || COALESCE(max(text) FILTER (turn % 2 = 1), '') AS content FROM s GROUP BY ALL) SELECT topic_id, pos, md5(content) AS digest FROM p WHERE length(content) > 50 AND topic_id NOT IN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)",
    "h3_gap_depth": f"WITH {_HEADS}, {_DEPTH} SELECT * FROM dg",
    "h5_split_questions": f"WITH {_OPEN}, q AS (SELECT qs.topic_id, qs.id, CASE WHEN g.id IS NOT NULL OR length(COALESCE(c.text, '')) < 20 THEN 'open' ELSE 'standard' END AS kind FROM qs LEFT JOIN gap g ON g.topic_id = qs.topic_id AND g.id = qs.id LEFT JOIN conversations c ON c.conv_id * 1000 + c.turn - 1 = qs.id WHERE len(words) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, kind ORDER BY id) AS rank FROM q) SELECT *, kind = 'open' AND rank <= 6 AS faq FROM r WHERE rank <= CASE kind WHEN 'open' THEN 8 ELSE 10 END",
    "e3_score_headings": f"WITH {_OPEN}, {_DEPTH}, {_TOPS}, {_LISTS}, mg AS ({_MERGED}), ca AS (SELECT topic_id, 1 AS pool, rank AS k, heading, sources AS n FROM ({_SUPPORT.format('heads')}) UNION ALL SELECT topic_id, 2, rank, substring(question, 1, 60), 0 FROM mg JOIN qs USING (topic_id, id) WHERE rank <= 8 UNION ALL SELECT topic_id, 3, unnest(range({len(DEFAULTS)})), unnest({DEFAULTS!r}), 0 FROM (SELECT DISTINCT topic_id FROM heads) "
    f"UNION ALL SELECT topic_id, 4, row_number() OVER (PARTITION BY topic_id ORDER BY mean_words, heading), heading, 0 FROM dg QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY mean_words, heading) <= 5), cf AS (SELECT topic_id, lower(trim(heading, ' ')) AS low, pool, k, heading, n FROM ca WHERE trim(heading, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY topic_id, lower(trim(heading, ' ')) ORDER BY pool, k, heading) = 1) {_SCORES.format('cf')}",
    "e4_raw_fallback": f"WITH {_HEADS}, {_TOPS}, {_LISTS}, {_CLEANED}, raw AS (SELECT topic_id, src, string_split(heading, ' ')[1] AS heading FROM heads), c1 AS (SELECT topic_id, heading AS low, 1 AS pool, rank AS k, heading, sources AS n FROM ({_SUPPORT.format('clean')})), c2 AS (SELECT topic_id, heading AS low, 1 AS pool, rank AS k, heading, sources AS n FROM ({_SUPPORT.format('raw')})), s1 AS ({_SCORES.format('c1')}), s2 AS ({_SCORES.format('c2')}) SELECT * FROM s1 UNION ALL SELECT * FROM s2 WHERE topic_id NOT IN (SELECT topic_id FROM s1)",
    "e8_assign_to_sections": f"WITH {_TOPS}, {_FACTS}, pl AS (SELECT topic_id, rank AS section, list_filter(string_split(lower(gram || ' that with dans nicht'), ' '), lambda w: length(w) > 3) AS hw FROM tops WHERE rank <= 4), it AS (SELECT DISTINCT topic_id, CASE WHEN ttype = 'eav' THEN 'fact' ELSE 'triple' END AS kind, subject || ' ' || predicate || ' ' || object AS item, 0 AS k FROM facts UNION ALL SELECT topic_id, 'pair', gram, rank FROM tops), "
    f"ft AS (SELECT topic_id, section, kind, item, k, min(section) OVER (PARTITION BY topic_id, kind, item, k) AS first FROM it JOIN pl USING (topic_id) WHERE len(list_filter(hw, lambda w: contains(lower(item), w))) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, section, kind ORDER BY k, item) AS rank FROM ft WHERE kind <> 'fact' OR section = first) SELECT topic_id, section, kind, rank, item FROM r WHERE rank <= CASE kind WHEN 'pair' THEN 3 ELSE 6 END",
}
