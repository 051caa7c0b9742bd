"""DuckDB SQL twins of the registered corpus queries."""

from __future__ import annotations

from textloom.functions.lists import BANNED, BUDGETS, CSS, ENTITIES, FACTS, LEXICON, PART_ENTITIES, PHRASES, SCRIPTS, SHOP, STOP, STYLE_STOP, WEIGHTED
from textloom.operators.text import CHROME_TAGS, COOKIES, LINE_TAGS, RAW, marks_of_chrome
from textloom.plans.tables import ARTICLE_SQL, KEYWORDS

_LIST = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_GRAMS = r"""
src AS (SELECT lang AS topic_id, COALESCE(source, '') AS src_idx, doc_id, text AS content FROM documents),
tok AS (SELECT topic_id, src_idx, doc_id, regexp_extract_all(lower(content), '(\p{L}+)', 1) AS words FROM src)"""
_STATS = _GRAMS + r""",
sg AS (SELECT item_id, text, COALESCE(sum(length(text)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM benchmark WHERE length(text) > 0),
sig AS (SELECT 'en' AS topic_id, NULL::VARCHAR AS src_idx, regexp_extract_all(lower(string_agg(text, ' . ' ORDER BY item_id)), '(\p{L}+)', 1) AS words FROM sg WHERE before < 20000),
alltok AS (SELECT topic_id, src_idx, words FROM tok UNION ALL SELECT * FROM sig),
gr AS (
  SELECT topic_id, src_idx, unnest(list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i + 1], ' '))) AS gram FROM alltok
  UNION ALL SELECT topic_id, src_idx, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) FROM alltok
  UNION ALL SELECT topic_id, src_idx, unnest(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) FROM alltok),
per AS (SELECT topic_id, gram, src_idx, count(*) AS n FROM gr GROUP BY ALL),
counted AS (SELECT topic_id, gram, COALESCE(sum(n) FILTER (src_idx IS NOT NULL), 0)::BIGINT AS freq, sum(n)::BIGINT AS freq_total, count(src_idx) AS sources, bool_or(src_idx IS NULL) AS in_signals, list_sort(list(n) FILTER (src_idx IS NOT NULL)) AS c FROM per GROUP BY ALL),
stats AS (SELECT topic_id, gram, freq, freq_total, sources, in_signals, COALESCE(c[1], 1) AS freq_min, COALESCE((c[(len(c) + 1) // 2] + c[len(c) // 2 + 1]) // 2, 1) AS freq_median, COALESCE(c[-1], 1) AS freq_max FROM counted)"""
_KEYWORDS = "kw(topic_id, keyword) AS (VALUES " + ", ".join(f"('{t}', '{k}')" for t, k in KEYWORDS) + ")"
_WEIGHT = _STATS + f""",
{_KEYWORDS},
ns AS (SELECT topic_id, count(DISTINCT src_idx) AS n_sources FROM src GROUP BY 1),
mx AS (SELECT topic_id, max(freq_total) AS top FROM stats GROUP BY 1),
joined AS (SELECT s.*, n_sources, keyword, sources / n_sources AS cover, freq / NULLIF(sources, 0) AS mean, list_has_any(string_split(gram, ' '), string_split(keyword, ' ')) AS own, round(0.5::DOUBLE * freq / top + 0.5::DOUBLE * (sources / n_sources), 4) + CASE WHEN contains(gram, keyword) THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN in_signals THEN 0.08::DOUBLE ELSE 0 END AS base FROM stats s JOIN ns USING (topic_id) JOIN mx USING (topic_id) JOIN kw USING (topic_id)),
weighted AS (
  SELECT *, round(LEAST(1.0::DOUBLE, CASE WHEN n_sources >= 3 AND sources >= 2 AND cover >= 0.6 AND mean <= 1.0 AND NOT own THEN base * 0.2::DOUBLE ELSE base END), 6) AS weight FROM joined
  WHERE (freq >= 2 OR (in_signals AND sources = 0)) AND (own OR NOT ((sources <= 1 AND freq >= 20) OR (n_sources >= 3 AND sources >= 2 AND cover >= 0.8 AND mean <= 1.5)))),
topped AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, gram) AS rank FROM weighted)"""
_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_SENT = r"""
parts AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+\s+')) AS s FROM documents),
sents AS (SELECT doc_id, trim(s, ' ') AS sentence FROM parts WHERE trim(s, ' ') <> '')"""
_COUNT = "((length(lower(text)) - length(replace(lower(text), '{0}', ''))) // length('{0}'))"
_BANNED = "(length(text) - length(translate(text, '%$#|', '')))"


def _phrase(p: str) -> str:
    return f"SELECT doc_id, '{p}' AS phrase, {_COUNT.format(p)} AS n FROM documents"


#: Lines that begin navigation.
NAV_LINES = r"(?i)licen[cs]e|cookie|menu"


def _visible(lines: bool = False) -> str:
    """``visible(page_id, content)``: chrome blocks end where the depth of their element falls below that of their opening tag."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    ends = f"CASE WHEN lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) IN ({quoted(LINE_TAGS)}) THEN chr(10) ELSE ' ' END" if lines else "' '"
    trimmed = r"trim(regexp_replace({}, '[ \t\n\f\r]+', ' ', 'g'), ' ')"
    joined = f"string_agg(CASE WHEN gone THEN '' ELSE piece END || {ends}, '' ORDER BY k)"
    content = f"array_to_string(list_filter(list_transform(string_split({joined}, chr(10)), lambda x: {trimmed.format('x')}), lambda x: x <> ''), chr(10))" if lines else trimmed.format(joined)
    marks = marks_of_chrome().replace("'", "''")
    return rf"""sp AS (SELECT page_id, regexp_split_to_array(x, '<[^>]+>') AS pieces, regexp_extract_all(x, '<[^>]+>') AS tags FROM (SELECT page_id, regexp_replace(html, '{RAW}', ' ', 'g') AS x FROM pages)),
nm AS (SELECT page_id, k, tag, starts_with(tag, '</') AS closing, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM (SELECT page_id, unnest(range(len(tags))) AS k, unnest(tags) AS tag FROM sp)),
dp AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY k) AS depth FROM nm WHERE name <> '' AND (closing OR NOT ends_with(tag, '/>'))),
op AS (SELECT d.page_id, d.k, min(z.k) AS stop FROM dp d JOIN dp z ON z.page_id = d.page_id AND z.name = d.name AND z.closing AND z.k > d.k AND z.depth = d.depth - 1 WHERE NOT d.closing AND (d.name IN ({quoted(CHROME_TAGS)}) OR regexp_matches(d.tag, '{marks}')) GROUP BY ALL),
pc AS (SELECT page_id, unnest(range(len(pieces))) AS k, unnest(pieces) AS piece, unnest(list_concat(tags, [''])) AS tag FROM sp),
fl AS (SELECT *, EXISTS (SELECT 1 FROM op WHERE op.page_id = pc.page_id AND op.k < pc.k AND pc.k <= op.stop) AS gone FROM pc),
visible AS (SELECT page_id, {content} AS content FROM fl GROUP BY page_id)"""


def _main_text() -> str:
    return f"WITH {_visible()} SELECT page_id, content FROM visible"


def _artifacts(x: str) -> str:
    x = rf"regexp_replace({x}, '&[a-zA-Z]+;|&#\d+;', ' ', 'g')"
    for p in (r"\[\d+\]", r"\{\{[^}]*\}\}", r"https?://\S+", r"\b[A-Z0-9]{20,}\b", *COOKIES):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return x


def _style() -> str:
    uses = lambda phrases: " + ".join(_COUNT.format(p).replace("lower(text)", "low") for p in phrases)
    chars = " + ".join(f"LEAST(10, length(body) - length(replace(body, '{c}', '')))" for c in "%$#|")
    opens = " OR ".join(f"starts_with(trim(s, ' '), '{o}')" for o in ("the ", "de "))
    return rf"""WITH b AS (SELECT doc_id, {ARTICLE_SQL} AS body FROM documents), l AS (SELECT *, lower(body) AS low FROM b), s AS (SELECT *, list_filter(string_split(regexp_replace(low, '([.!?])\s+', '\1' || chr(10) || chr(10) || chr(10), 'g'), chr(10) || chr(10) || chr(10)), lambda s: trim(s, ' ') <> '') AS sents FROM l),
w AS (SELECT *, list_transform(sents, lambda s: regexp_split_to_array(trim(s, ' '), '\s+')[1]) AS starts, list_filter(list_transform(sents, lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> ''))), lambda n: n > 2) AS lens, list_transform(list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: trim(p, ' ')), lambda p: p <> '' AND NOT starts_with(p, '#')), lambda p: len(list_filter(regexp_split_to_array(p, '[.!?]+\s+'), lambda s: trim(s, ' ') <> ''))) AS c FROM s),
n AS (SELECT doc_id, ({uses(PHRASES)})::BIGINT AS n_forbidden, len(list_filter(sents, lambda s: {opens})) AS n_openers, ({uses(BANNED)})::BIGINT AS n_banned, ({chars})::BIGINT AS n_chars, len(list_filter(list_distinct(starts), lambda x: NOT list_contains({STYLE_STOP!r}, x) AND len(list_filter(starts, lambda y: y = x)) > 3)) AS n_starts, len(list_filter(range(1, len(c) - 2), lambda i: c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3])) > 0 AS even,
CASE WHEN len(lens) >= 5 THEN round(list_stddev_pop(lens), 6) END AS spread, len(regexp_extract_all(body, '(?m)^\s*[-•*]\s+')) AS n_items, len(regexp_extract_all(body, '\*\*[^*]+\*\*')) AS n_bold, length(body) - length(replace(body, chr(39), '')) AS n_quotes FROM w),
z AS (SELECT *, GREATEST(0, 100 - (5 * n_forbidden + 4 * n_openers + 3 * n_banned + 2 * n_chars + 2 * n_starts + CASE WHEN even THEN 3 ELSE 0 END + CASE WHEN spread < 3.0 THEN 3 ELSE 0 END + CASE WHEN n_items > 12 THEN 5 ELSE 0 END + CASE WHEN n_bold > 3 THEN 3 ELSE 0 END + CASE WHEN n_quotes > 2 THEN 2 ELSE 0 END))::BIGINT AS score FROM n) SELECT *, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS class FROM z"""


TWINS = {
    "a3_filter_urls": r"SELECT page_id, url FROM pages WHERE NOT (contains(lower(url), 'utm_source') OR contains(lower(url), 'blog.') OR regexp_matches(lower(url), '\.(pdf|doc|docx|xls|xlsx)$'))",
    "a4_admit_sources": rf"WITH {_GRAMS}, sized AS (SELECT *, length(content) AS chars FROM src WHERE length(content) >= 500 AND len(regexp_extract_all(content, '(?m)^#{{1,6}}\s')) <= 15), run AS (SELECT *, COALESCE(sum(chars) OVER (PARTITION BY topic_id ORDER BY src_idx, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized) SELECT topic_id, src_idx, doc_id, chars, len({_WORDS.format('content')}) AS word_count FROM run WHERE before < 200000",
    "a6_with_domain": r"SELECT page_id, CASE WHEN regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) <> '' THEN regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) ELSE substring(url, 1, 30) END AS domain FROM pages",
    "a10_strip_markup": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\s*', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^-{3,}$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS digest FROM documents""",
    "b1_html_headings": r"""WITH f AS (SELECT page_id, regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS hs FROM pages), e AS (SELECT page_id, unnest(range(len(hs))) AS pos, trim(regexp_replace(unnest(hs), '<[^>]+>', '', 'g'), ' ') AS heading FROM f) SELECT * FROM e WHERE length(heading) > 0 AND length(heading) < 200 AND NOT regexp_matches(heading, '[{}]|webkit|@media')""",
    "b2_html_main_text": _main_text(),
    "b4_strip_artifacts": f"SELECT page_id, md5({_artifacts('html')}) AS digest FROM pages",
    "b5_line_features": rf"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents), w AS (SELECT *, {_WORDS.format('line')} AS words FROM l),
c AS (SELECT doc_id, pos, line, length(line) AS chars, len(words) AS n_words, len(list_filter(words, lambda x: list_contains({_LIST}, lower(x)))) / GREATEST(len(words), 1) AS density, len(list_filter(words, lambda x: regexp_matches(x, '^\p{{Lu}}'))) / GREATEST(len(words), 1) AS capital, regexp_matches(line, '[.!?]$') AS fin FROM w)
SELECT doc_id, pos, chars, n_words, round(density, 6) AS density, round(capital, 6) AS capital, (chars < 5) OR (chars < 60 AND density < 0.15 AND NOT fin) OR (chars < 60 AND capital > 0.6 AND n_words <= 5) OR (n_words <= 3 AND density = 0 AND NOT fin) AS boilerplate FROM c""",
    "b8_finish_text": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ')) AS digest FROM documents",
    "d1_tokens": f"WITH {_GRAMS} SELECT doc_id, len(words) AS n_tokens, md5(array_to_string(words, ' ')) AS digest FROM tok",
    "d4_gram_stats": f"WITH {_STATS} SELECT * FROM stats",
    "d4_gram_displays": f"WITH {_GRAMS}, lx(surface, lemma) AS (VALUES " + ", ".join(f"('{x}', '{y}')" for x, y in LEXICON) + "), lm AS (SELECT MAP(list(surface), list(lemma)) AS m FROM lx), "
    "tw AS (SELECT topic_id, words, list_transform(words, lambda w: COALESCE(m[w], w)) AS lemmas FROM tok, lm), g AS (SELECT topic_id, unnest(list_transform(range(1, len(words)), lambda i: lemmas[i] || ' ' || lemmas[i + 1])) AS gram, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS surface FROM tw), "
    "c AS (SELECT topic_id, gram, surface, count(*) AS n FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, gram ORDER BY n DESC, surface) AS k, sum(n) OVER (PARTITION BY topic_id, gram)::BIGINT AS freq FROM c) SELECT topic_id, gram, surface AS display, freq FROM r WHERE k = 1 AND freq >= 2",
    "d7_weight_grams": f"WITH {_WEIGHT} SELECT topic_id, gram, freq, sources, in_signals, weight FROM weighted",
    "d8_top_grams": f"WITH {_WEIGHT} SELECT topic_id, rank, gram, freq, sources, freq_min, freq_median, freq_max, weight FROM topped WHERE rank <= 30",
    "d9_extended_terms": f"WITH {_WEIGHT}, rest AS (SELECT * EXCLUDE (rank) FROM topped WHERE rank > 30 AND n_sources >= 3 AND sources >= GREATEST(2, floor(0.3::DOUBLE * n_sources)) AND sources <= floor(0.8::DOUBLE * n_sources)), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY sources DESC, weight DESC, gram) AS rank FROM rest) SELECT topic_id, rank, gram, sources, weight FROM r WHERE rank <= 15",
    "d13_repeated_trigrams": f"WITH w AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS words FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) AS gram FROM w WHERE len(words) > 5), c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS k FROM c) SELECT doc_id, gram, n FROM r WHERE k <= 10 AND n >= 4 AND length(gram) > 10 AND len(list_filter(string_split(gram, ' '), lambda w: NOT list_contains({_LIST}, w))) > 0",
    "h6_keyword_cosine": "WITH k AS (SELECT label, arg_min(embedding, vec_id) AS key FROM embeddings GROUP BY label) SELECT vec_id, e.label, round(list_cosine_similarity(embedding::DOUBLE[], key::DOUBLE[]), 6) AS sim FROM embeddings e JOIN k ON e.label = k.label",
    "j2_phrase_hits": "SELECT * FROM (" + " UNION ALL ".join(map(_phrase, PHRASES)) + ") WHERE n > 0",
    "j3_opener_hits": f"WITH {_SENT}, o AS (SELECT doc_id, CASE WHEN starts_with(lower(sentence), 'the ') THEN 'the ' WHEN starts_with(lower(sentence), 'de ') THEN 'de ' WHEN starts_with(lower(sentence), 'le ') THEN 'le ' END AS opener FROM sents) SELECT doc_id, opener, count(*) AS n FROM o WHERE opener IS NOT NULL GROUP BY ALL",
    "j4_char_hits": f"SELECT doc_id, {_BANNED} AS n FROM documents WHERE {_BANNED} > 0",
    "j5_entity_coverage": "WITH p AS (SELECT doc_id, contains(lower(text), 'license')::BIGINT + contains(lower(text), 'the')::BIGINT + contains(lower(text), 'idiot')::BIGINT AS n_present FROM documents) SELECT doc_id, n_present, 3 - n_present AS n_missing FROM p",
    "j7_uniform_paragraphs": r"WITH p AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS par FROM documents), c AS (SELECT doc_id, pos, len(list_filter(regexp_split_to_array(par, '[.!?]+'), lambda s: trim(s, ' ') <> '')) AS n FROM p WHERE trim(par, ' ') <> ''), l AS (SELECT *, lead(n, 1) OVER w AS n1, lead(n, 2) OVER w AS n2, lead(n, 3) OVER w AS n3 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, n FROM l WHERE n = n1 AND n = n2 AND n = n3",
    "j8_list_groups": rf"WITH p AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, regexp_matches(unnest(string_split(text, chr(10))), '^\s*(?:[-*|]|\d+[.)])\s?') AS item FROM (SELECT doc_id, {ARTICLE_SQL} AS text FROM documents)), b AS (SELECT *, lag(item, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM p) SELECT doc_id, count(*) FILTER (WHERE item AND NOT before) AS groups, count(*) FILTER (WHERE item) AS items FROM b GROUP BY doc_id HAVING count(*) FILTER (WHERE item) > 0",
    "j15_style_score": _style(),
}

_HEADS = r"""
f AS (SELECT page_id, url, COALESCE(NULLIF(regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1), ''), substring(url, 1, 30)) AS src, regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS hs FROM pages),
e AS (SELECT page_id, url, src, unnest(range(len(hs))) AS pos, trim(regexp_replace(unnest(hs), '<[^>]+>', '', 'g'), ' ') AS heading FROM f),
heads AS (SELECT regexp_extract(url, '^https?://[^/]+/([a-z]{2})(?:/|$)', 1) AS topic_id, src, page_id, pos, heading FROM e WHERE length(heading) > 0 AND length(heading) < 200 AND NOT regexp_matches(heading, '[{}]|webkit|@media'))"""
_NSRC = "ns AS (SELECT topic_id, count(DISTINCT src) AS n_sources FROM heads GROUP BY 1)"
_LENGTHS = sorted({len(p.split()) for p, _ in ENTITIES})
_MENTIONS = _GRAMS + ", gaz(phrase, etype) AS (VALUES " + ", ".join(f"('{p}', '{t}')" for p, t in ENTITIES) + "), runs AS (" + " UNION ALL ".join(
    f"SELECT topic_id, src_idx, doc_id, {k} AS n_words, unnest(range(len(words) - {k - 1})) AS pos, unnest(list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i + {k - 1}], ' '))) AS phrase FROM tok JOIN (SELECT doc_id FROM src WHERE length(content) >= 100) USING (doc_id) WHERE len(words) >= {k}" for k in _LENGTHS
) + "), every AS (SELECT * FROM runs JOIN gaz USING (phrase)), m AS (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM every o WHERE o.doc_id = e.doc_id AND o.pos <= e.pos AND o.pos + o.n_words >= e.pos + e.n_words AND o.n_words > e.n_words))"


def _units(name: str, mark: str) -> str:
    """``name(doc_id, k, begin, stop, size, piece)``: parts of texts between marks and where they lie."""
    return rf"""{name}_a AS (SELECT doc_id, regexp_split_to_array(content, '{mark}') AS parts, regexp_extract_all(content, '{mark}') AS marks FROM src),
{name}_b AS (SELECT doc_id, unnest(range(len(parts))) AS k, unnest(parts) AS piece, unnest(list_concat(list_transform(marks, lambda x: length(x)), [1])) AS gap FROM {name}_a),
{name} AS (SELECT doc_id, k, length(piece) AS size, piece, sum(length(piece) + gap) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) - gap AS begin, sum(length(piece) + gap) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM {name}_b)"""


_PLACES = _MENTIONS + ", " + _units("gaps", r"\p{L}+") + ", " + _units("sentence", r"[.!?]+[ \t\n\f\r]+") + ", " + _units("paragraph", r"\n[ \t\n\f\r]*\n") + r""",
placed AS (SELECT m.*, (a.begin + a.size)::BIGINT AS start_char, z.stop::BIGINT AS end_char FROM m JOIN gaps a ON a.doc_id = m.doc_id AND a.k = m.pos JOIN gaps z ON z.doc_id = m.doc_id AND z.k = m.pos + m.n_words - 1),
places AS (SELECT p.*, s.k AS sentence, substring(trim(s.piece, ' '), 1, 200) AS sentence_text, g.k AS paragraph, g.size AS paragraph_chars, substring(c.content, start_char + 1, end_char - start_char) AS surface, substring(c.content, GREATEST(start_char - 50, 0) + 1, end_char + 50 - GREATEST(start_char - 50, 0)) AS context
FROM placed p JOIN src c ON c.doc_id = p.doc_id JOIN sentence s ON s.doc_id = p.doc_id AND s.begin <= start_char AND start_char < s.stop JOIN paragraph g ON g.doc_id = p.doc_id AND g.begin <= start_char AND start_char < g.stop),
ns AS (SELECT topic_id, count(DISTINCT src_idx) AS n_sources FROM src GROUP BY 1)"""
_DETAILS = f"""WITH {_PLACES}, per AS (SELECT topic_id, phrase, etype, src_idx, count(*) AS n FROM places GROUP BY ALL),
rng AS (SELECT topic_id, phrase, etype, min(n) AS freq_min, floor(quantile_cont(n, 0.5))::BIGINT AS freq_median, max(n) AS freq_max FROM per GROUP BY ALL),
sf AS (SELECT topic_id, phrase, etype, surface FROM places QUALIFY row_number() OVER (PARTITION BY topic_id, phrase, etype ORDER BY src_idx, doc_id, start_char) = 1),
cx AS (SELECT topic_id, phrase, etype, context, src_idx, doc_id, start_char FROM places QUALIFY row_number() OVER (PARTITION BY topic_id, phrase, etype, context ORDER BY src_idx, doc_id, start_char) = 1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY topic_id, phrase, etype ORDER BY src_idx, doc_id, start_char, context) AS r FROM cx),
cs AS (SELECT topic_id, phrase, etype, string_agg(context, ' | ' ORDER BY r) AS contexts FROM c3 WHERE r <= 3 GROUP BY ALL)
SELECT topic_id, phrase, etype, surface, freq_min, freq_median, freq_max, contexts FROM rng JOIN sf USING (topic_id, phrase, etype) JOIN cs USING (topic_id, phrase, etype)"""


def _joint(unit: str, more: str = "") -> str:
    return f"SELECT DISTINCT x.topic_id, x.phrase AS a, y.phrase AS b, x.src_idx, x.doc_id, x.{unit}{more} FROM kept x JOIN kept y ON x.topic_id = y.topic_id AND x.doc_id = y.doc_id AND x.{unit} = y.{unit} AND x.phrase < y.phrase"


def _cooccurrence() -> str:
    return f"""WITH {_PLACES}, first AS ({TWINS['f2_entity_stats']}), kept AS (SELECT p.* FROM places p JOIN (SELECT DISTINCT topic_id, phrase FROM first) USING (topic_id, phrase)),
near AS ({_joint('sentence', ', x.sentence_text')}), wide AS ({_joint('paragraph')} WHERE x.paragraph_chars >= 50),
nn AS (SELECT topic_id, a, b, count(*) AS n, count(DISTINCT src_idx) AS sources FROM near GROUP BY ALL), cc AS (SELECT topic_id, a, b, sentence_text AS context FROM near QUALIFY row_number() OVER (PARTITION BY topic_id, a, b ORDER BY src_idx, doc_id, sentence) = 1), ww AS (SELECT topic_id, a, b, count(*) AS paragraphs FROM wide GROUP BY ALL),
al AS (SELECT topic_id, a, b, COALESCE(n, 0) AS n, COALESCE(paragraphs, 0) AS paragraphs, COALESCE(sources, 0) AS sources, context FROM nn FULL JOIN ww USING (topic_id, a, b) LEFT JOIN cc USING (topic_id, a, b)),
st AS (SELECT al.*, round(LEAST(1.0::DOUBLE, (3 * n + paragraphs) * CASE WHEN sources >= 2 THEN 1 + 0.2::DOUBLE * sources ELSE 1.0::DOUBLE END / 50), 6) AS strength FROM al JOIN ns USING (topic_id) WHERE n + paragraphs >= CASE WHEN n_sources <= 4 THEN 1 ELSE 2 END),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY strength DESC, a, b) AS rank FROM st) SELECT * FROM r WHERE rank <= 20"""


def _css() -> str:
    x = "html"
    for p in CSS:
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return rf"SELECT page_id, md5(trim(regexp_replace({x}, '\s+', ' ', 'g'), ' ')) AS digest FROM pages"


def _clean_headings() -> str:
    garbage = " OR ".join(f"contains(lower(heading), '{g}')" for g in SHOP)
    return (
        f"WITH {_HEADS}, w AS (SELECT *, {_WORDS.format('lower(heading)')} AS words, trim(regexp_replace(lower(heading), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') AS norm FROM heads), "
        f"c AS (SELECT *, row_number() OVER (PARTITION BY topic_id, norm ORDER BY page_id, pos) AS k FROM w WHERE length(heading) BETWEEN 8 AND 120 AND len(words) BETWEEN 2 AND 15 AND len(list_filter(words, lambda x: NOT list_contains({_LIST}, x))) > 0 "
        rf"AND NOT ({garbage} OR regexp_matches(heading, '[{{}}<>|\\@#$^*=~]|https?://|www\.') OR regexp_matches(heading, '^[\d\s]+$'))) SELECT topic_id, src, page_id, pos, heading FROM c WHERE k = 1"
    )


def _coverage(strict: bool) -> str:
    states = []
    for p, least, most, w in WEIGHTED:
        if len(p) < (4 if strict else 3):
            continue
        least, n = max(least, 1) if strict else least, _COUNT.format(p)
        most = most if most is not None else 3 * max(least, 1) if strict else 99
        states.append(f"{{'p': '{p}', 'w': {w}::DOUBLE, 'k': CASE WHEN {n} = 0 AND {least} > 0 THEN 'missing' WHEN {n} < {least} THEN 'under' WHEN {n} > {most} THEN 'over' ELSE 'ok' END}}")
    counts = ", ".join(f"len(list_filter(s, lambda x: x.k = '{k}')) AS n_{k}" for k in ("missing", "under", "over", "ok"))
    covered = "n_ok" if strict else "n_ok + n_under"
    return f"WITH s AS (SELECT doc_id, [{', '.join(states)}] AS s FROM documents), c AS (SELECT doc_id, {counts}, array_to_string(list_transform(list_sort(list_transform(list_filter(s, lambda x: x.k = 'missing' AND x.w >= 0.3), lambda x: {{'w': -x.w, 'p': x.p}})), lambda x: x.p), ', ') AS important FROM s) SELECT *, round(100 * ({covered}) / {len(states)}, 2) AS coverage_pct FROM c"


_SHAPES = r"length(line) < 3 OR (length(line) < 30 AND regexp_matches(line, '[→►»›]$')) OR regexp_matches(line, '^[-=_*|•·]+$') OR regexp_matches(line, '^\d+$') OR regexp_matches(line, '^\p{L}{1,4}$') OR regexp_matches(line, '^\p{L}{3,12}\.? (?:19|20)\d\d$')"


def _displays() -> str:
    """The flagship over lemmas without signals; of each ranked gram the way it is written most."""
    lemma = "CASE w " + " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in LEXICON) + " ELSE w END"
    plain = r"tok AS (SELECT topic_id, src_idx, doc_id, regexp_extract_all(lower(content), '(\p{L}+)', 1) AS words FROM src)"
    both = plain.replace("tok AS", "tk AS").replace("AS words", "AS surfaces") + f", tok AS (SELECT topic_id, src_idx, doc_id, surfaces, list_transform(surfaces, lambda w: {lemma}) AS words FROM tk)"
    weight = _WEIGHT.replace(plain, both).replace(" UNION ALL SELECT * FROM sig", "")
    runs = " UNION ALL ".join(f"SELECT topic_id, unnest(list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(words[i:i + {n - 1}], ' '))) AS gram, unnest(list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(surfaces[i:i + {n - 1}], ' '))) AS surface FROM tok" for n in (2, 3, 4))
    return f"WITH {weight}, runs AS ({runs}), c AS (SELECT topic_id, gram, surface, count(*) AS n FROM runs JOIN (SELECT topic_id, gram FROM topped WHERE rank <= 30) USING (topic_id, gram) GROUP BY ALL), d AS (SELECT topic_id, gram, surface AS display FROM c QUALIFY row_number() OVER (PARTITION BY topic_id, gram ORDER BY n DESC, surface) = 1) SELECT topic_id, rank, gram, display, freq, sources, weight FROM topped JOIN d USING (topic_id, gram) WHERE rank <= 30"


def _clean_lines(docs: str, key: str) -> str:
    """Lines of ``docs(key, text)``: the skip as a state that passes from line to line, then the judgement of lines."""
    rests = "(n + 1 > 3 AND length(h.line) > 50) OR n + 1 > 8"
    return rf"""WITH RECURSIVE given AS ({docs}), l AS (SELECT {key}, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM given), h AS (SELECT *, regexp_matches(line, '{NAV_LINES}') AND length(line) < 150 AS hit FROM l),
st AS (SELECT {key}, -1::BIGINT AS pos, false AS skip, 0 AS n, '' AS line, false AS keep FROM (SELECT DISTINCT {key} FROM h) UNION ALL SELECT h.{key}, h.pos, CASE WHEN hit THEN true WHEN skip AND NOT ({rests}) THEN true ELSE false END, CASE WHEN hit THEN 0 WHEN skip THEN n + 1 ELSE 0 END, h.line, NOT hit AND NOT (skip AND NOT ({rests})) FROM st JOIN h ON h.{key} = st.{key} AND h.pos = st.pos + 1),
jw AS (SELECT *, {_WORDS.format('line')} AS words, regexp_matches(line, '[.!?]$') AS fin, length(line) AS chars FROM st),
jc AS (SELECT *, len(words) AS n_words, len(list_filter(words, lambda x: list_contains({_LIST}, lower(x)))) / GREATEST(len(words), 1) AS density, len(list_filter(words, lambda x: regexp_matches(x, '^\p{{Lu}}'))) / GREATEST(len(words), 1) AS capital FROM jw),
jd AS (SELECT {key}, pos, line, keep AND NOT ({_SHAPES} OR (n_words BETWEEN 1 AND 2 AND capital = 1) OR (n_words < 2 AND NOT regexp_matches(line, '\d')) OR chars < 5 OR (chars < 60 AND density < 0.15 AND NOT fin) OR (chars < 60 AND capital > 0.6 AND n_words <= 5) OR (n_words <= 3 AND density = 0 AND NOT fin)) AS keep FROM jc)
SELECT {key}, COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '') AS text FROM jd GROUP BY 1"""


def _best_text() -> str:
    long = r"list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: length(w) > 3)"
    second = r"regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), chr(10)), '<[^>]+>', ' ', 'g')"
    checked = f"SELECT page_id, CASE WHEN trim(a, ' ') = '' THEN b WHEN length(b) <= 200 THEN a ELSE array_to_string(list_filter(string_split(a, chr(10)), lambda x: length(x) >= 50 OR 2 * len(list_filter({long}, lambda w: contains(lower(b), w))) >= len({long})), chr(10)) END AS c FROM (SELECT page_id, content AS a, {second} AS b FROM visible JOIN pages USING (page_id))"
    lines = _clean_lines(f"WITH {_visible(True)} SELECT page_id, {_artifacts('c')} AS text FROM ({checked})", "page_id")
    return rf"SELECT page_id, trim(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ') AS content FROM ({lines})"


TWINS |= {
    "b6_flag_nav_lines": f"WITH b AS ({TWINS['b5_line_features']}), l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) SELECT doc_id, pos, boilerplate OR {_SHAPES} OR (n_words BETWEEN 1 AND 2 AND capital = 1) AS nav FROM b JOIN l USING (doc_id, pos)",
    "b9_strip_css": _css(),
    "e1_clean_headings": _clean_headings(),
    "e2_heading_support": f"WITH {_HEADS}, {_NSRC}, c AS (SELECT topic_id, lower(heading) AS heading, count(DISTINCT src) AS sources FROM heads GROUP BY ALL), r AS (SELECT c.*, row_number() OVER (PARTITION BY topic_id ORDER BY sources DESC, heading) AS rank FROM c JOIN ns USING (topic_id) WHERE sources >= CASE WHEN n_sources <= 5 THEN 2 ELSE 3 END) SELECT * FROM r WHERE rank <= 40",
    "e5_topical_coverage": f"WITH {_HEADS}, {_NSRC}, c AS (SELECT topic_id, array_to_string(regexp_extract_all(lower(heading), '\\p{{L}}{{3,}}')[1:3], ' ') AS pattern, count(DISTINCT src) AS sources, min(heading) AS sample FROM heads WHERE length(heading) >= 5 GROUP BY ALL), "
    "r AS (SELECT topic_id, pattern, sources, sample, CASE WHEN sources / n_sources >= 0.7 THEN 'MUST' WHEN sources / n_sources >= 0.5 THEN 'HIGH' WHEN sources / n_sources >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS class, round(sources / n_sources, 6) AS ratio, row_number() OVER (PARTITION BY topic_id ORDER BY sources DESC, pattern) AS rank FROM c JOIN ns USING (topic_id) WHERE pattern <> '') SELECT * FROM r WHERE rank <= 15",
    "f1_match_entities": f"WITH {_PLACES} SELECT topic_id, doc_id, pos, start_char, end_char, phrase, etype FROM places",
    "f2_entity_stats": f"WITH {_MENTIONS}, ns AS (SELECT topic_id, count(DISTINCT src_idx) AS n_sources FROM src GROUP BY 1), c AS (SELECT topic_id, phrase, etype, count(*) AS freq, count(DISTINCT src_idx) AS sources FROM m GROUP BY ALL), "
    "i AS (SELECT c.*, round(LEAST(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN etype IN ('PERSON', 'ORGANIZATION', 'PRODUCT') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + LEAST(0.25::DOUBLE, 0.08::DOUBLE * ln(freq + 1)) + 0.25::DOUBLE * sources / n_sources), 6) AS importance FROM c JOIN ns USING (topic_id)), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY importance DESC, phrase) AS rank FROM i) SELECT * FROM r WHERE rank <= 50",
    "g1_bundle_texts": f"WITH {_GRAMS}, q AS (SELECT topic_id, src_idx, doc_id, substring(content, 1, 3000) AS piece FROM src WHERE length(content) > 100), run AS (SELECT *, COALESCE(sum(length(piece)) OVER (PARTITION BY topic_id ORDER BY src_idx, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q), b AS (SELECT topic_id, string_agg(piece, chr(10) ORDER BY src_idx, doc_id) AS bundle FROM run WHERE before < 8000 GROUP BY 1) SELECT topic_id, length(bundle) AS chars, md5(bundle) AS digest FROM b WHERE length(bundle) >= 200",
    "h10_target_length": f"WITH n AS (SELECT lang, len({_WORDS.format('text')}) AS n FROM documents), a AS (SELECT lang, floor(COALESCE(quantile_cont(n, 0.5) FILTER (n > 200), 2000))::BIGINT AS target, round(COALESCE(avg(n) FILTER (n > 200), 0.0), 4) AS mean_words FROM n GROUP BY 1) SELECT *, LEAST(180, target // 9) AS intro FROM a",
    "h11_hard_facts": "WITH u AS (" + " UNION ALL ".join(f"SELECT lang, doc_id, text, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS raw FROM documents" for k, p in FACTS.items()) + "), v AS (SELECT lang, kind, regexp_replace(raw, '\\s+', '', 'g') AS value, struct_pack(d := doc_id, c := substring(text, GREATEST(strpos(text, raw) - 60, 1), strpos(text, raw) + length(raw) + 60 - GREATEST(strpos(text, raw) - 60, 1))) AS spot FROM u), c AS (SELECT lang, kind, value, count(*) AS n, struct_extract(min(spot), 'c') AS context FROM v WHERE length(value) > 2 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, kind, value) AS rank FROM c) SELECT * FROM r WHERE rank <= 25",
    "h14_dedup_records": r"WITH s AS (SELECT conv_id, turn, upper(regexp_replace(text, '\s+', '', 'g')) AS s FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY conv_id, turn) AS k FROM s) SELECT conv_id, turn FROM r WHERE k = 1 OR s IS NULL OR s = ''",
    "j1_sentences": r"WITH p AS (SELECT doc_id, regexp_split_to_array(text, '[.!?]+\s+') AS a FROM documents), q AS (SELECT doc_id, unnest(range(len(a))) AS pos, trim(unnest(a), ' ') AS s FROM p) SELECT doc_id, pos, md5(s) AS digest FROM q WHERE s <> ''",
    "j9_foreign_scripts": " UNION ALL ".join(f"SELECT doc_id, '{k}' AS script, unnest(regexp_extract_all(translate(text, 'zjqx', 'жй中م'), '{p}')[1:{n}]) AS run FROM documents" for k, (p, n) in SCRIPTS.items()),
    "j17_gram_coverage": _coverage(True),
    "j17_gram_coverage_audit": _coverage(False),
    "l3_budgets_from_grams": f"WITH {_WEIGHT} SELECT topic_id, gram, freq_min AS low, GREATEST(freq_max, 1) AS high FROM topped WHERE rank <= 30",
}
TWINS["h6_similar_pairs"] = "SELECT x.label, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS sim FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.3"
TWINS["d8_top_displays"] = _displays()
TWINS |= {"b7_clean_lines": _clean_lines("SELECT doc_id, text FROM documents", "doc_id"), "b10_best_text": _best_text()}
TWINS |= {"f2_entity_details": _DETAILS, "f13_cooccurrence": _cooccurrence()}
TWINS |= {
    "k1_budget_batches": "WITH u AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{p}' AS phrase, {a} AS low, {b} AS high, COALESCE({_COUNT.format(p)}, 0) AS used FROM conversations" for p, a, b in BUDGETS)
    + "), s AS (SELECT *, sum(used) OVER (PARTITION BY conv_id, phrase ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM u) SELECT conv_id, turn, phrase, used, CASE WHEN used > GREATEST(high - (spent - used), 0) THEN 'OVER' ELSE 'OK' END AS status, GREATEST(low - spent, 0) AS low_left, GREATEST(high - spent, 0) AS high_left FROM s",
    "k2_check_parts": "WITH b AS (SELECT conv_id, turn, COALESCE(text, '') AS text, lower(COALESCE(text, '')) AS low FROM conversations), c AS (SELECT conv_id, turn, " + " + ".join(f"contains(low, '{p}')::BIGINT" for p in PHRASES) + f" AS n_phrases, {_BANNED} AS n_chars, " + " + ".join(f"(NOT contains(low, '{e}'))::BIGINT" for e in PART_ENTITIES)
    + " AS n_missing, NOT contains(low, 'is') AS main_missing FROM b) SELECT *, CASE WHEN n_phrases > 0 THEN 'high' WHEN n_missing > 0 THEN 'medium' WHEN main_missing OR n_chars > 0 THEN 'low' ELSE 'none' END AS severity, GREATEST(0, 100 - 5 * n_phrases - n_chars - 3 * n_missing - CASE WHEN main_missing THEN 3 ELSE 0 END) AS score FROM c",
}
