"""DuckDB SQL of those operators that SQL can express."""

from __future__ import annotations

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', CASE WHEN doc_id IS NULL THEN 'n' ELSE 's' || CAST(doc_id AS VARCHAR) END,
                            CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END,
                            CASE WHEN text IS NULL THEN 'n' ELSE 's' || md5(text) END)) AS ord
  FROM documents),
totals AS (
  SELECT source, SUM(size)::DOUBLE AS source_size,
         (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS k
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE k WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 2 * source_size AS most,
         CASE k WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS b,
         CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS e
  FROM totals),
levels AS (
  SELECT most / weight AS ratio,
         (1.5 * (SELECT SUM(source_size) FROM totals) - COALESCE((SELECT SUM(x.most) FROM weighted x WHERE x.most / x.weight < w.most / w.weight), 0))
         / (SELECT SUM(x.weight) FROM weighted x WHERE x.most / x.weight >= w.most / w.weight) AS level
  FROM weighted w),
level AS (SELECT COALESCE(arg_min(level, ratio), 'infinity'::DOUBLE) AS level FROM levels WHERE level <= ratio),
targets AS (
  SELECT source, source_size, b, e,
         CASE WHEN level * weight > most THEN most ELSE level * weight END AS target
  FROM weighted, level),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.b, t.e,
         COALESCE(SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM placed),
taken AS (
  SELECT *, (passes + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END)::BIGINT AS copies FROM passed),
done AS (
  SELECT *, list_transform(range(copies), lambda i: LEAST(1.0::DOUBLE, (i * source_size + before + size / 2) / GREATEST(target, 1.0))) AS shares FROM taken)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (copies * size)::BIGINT AS taken,
       array_to_string(list_transform(shares, lambda d: CAST(CAST(round(CASE WHEN b = e THEN d ELSE (sqrt(b * b + (e * e - b * b) * d) - b) / (e - b) END, 9) AS DECIMAL(12, 9)) AS VARCHAR)), ',') AS positions
FROM done
"""

#: CRC-32 as a macro would have it: the table by its rule, then one step a byte.
SPELLING = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(i))),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, COUNT(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
keyed AS (SELECT *, hex(encode(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
summed AS (
  SELECT run, c, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(x) // 2), lambda k: ('0x' || x[2 * k + 1 : 2 * k + 2])::BIGINT),
                                 lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM keyed, crc),
harmed AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM summed),
words AS (SELECT word, SUM(c)::BIGINT AS n FROM harmed WHERE length(word) >= 6 GROUP BY word HAVING SUM(c) >= 5),
cut AS (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, COUNT(*) AS n_near, arg_min(near, (-m, near)) AS near, MAX(m) AS m FROM pairs GROUP BY word),
known AS (
  SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN near END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS at, form AS further FROM known
  UNION ALL SELECT c.word, k.word, k.form FROM chain c JOIN known k ON c.further = k.word)
SELECT k.word, k.form, c.at AS root, k.n, k.n_near, k.form_n FROM known k JOIN chain c ON k.word = c.word AND c.further IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": MIXING, "op11_spelling": SPELLING}
