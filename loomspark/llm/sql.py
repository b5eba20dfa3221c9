"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

# Every 400-byte window of every text by its digest; windows that occur twice are merged into spans.
ORACLE_SQL["op1_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT r, doc_id, b, octet_length(b) AS n_bytes FROM d),
w AS (SELECT r, i, md5(array_slice(b, i + 1, i + 400)) AS k FROM (SELECT r, b, unnest(range(0, n_bytes - 399)) AS i FROM n WHERE n_bytes >= 400)),
c AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT r, i, (i > lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) + 400)::INT AS new FROM w SEMI JOIN c USING (k)),
s AS (SELECT r, g, min(i) AS a, max(i) + 400 AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM m) GROUP BY r, g),
p AS (SELECT r, a, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY a) AS f FROM s),
g AS (SELECT p.r, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(hex(array_slice(b, f + 1, a)), '' ORDER BY a) AS h, max(e) AS last FROM p JOIN n ON n.r = p.r GROUP BY p.r)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN g.r IS NULL THEN b ELSE unhex(h || hex(array_slice(b, last + 1, n_bytes))) END) AS kept_sha256 FROM n LEFT JOIN g ON g.r = n.r
"""

ORACLE_SQL["op5_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM pat),
win AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN pat ON win.p = pat.p AND win.n = pat.n),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL["op9_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[]/?)(\\*)(s>|INST\]|SYS\]|ANS\]|ROLE\]|\+\])', '\1\\\2\3', 'g')) AS n,
    length(regexp_replace(role, '([<\[]/?)(\\*)(s>|INST\]|SYS\]|ANS\]|ROLE\]|\+\])', '\1\\\2\3', 'g')) AS r,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + CASE WHEN before = role THEN 3 WHEN role = 'user' THEN 13 WHEN role = 'system' THEN 11
    WHEN role = 'assistant' THEN 9 ELSE 16 + r END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL["op10_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, lang AS stratum, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
v AS (SELECT id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
rep AS (SELECT id, i, count(*) OVER (PARTITION BY id, w[i : i + 4]) AS c FROM v),
cov AS (SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS k FROM rep WHERE c > 1) GROUP BY id),
m AS (
  SELECT doc_id, stratum, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_marks,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (id)),
s AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(n_symbols * 1000 // nullif(n_words, 0), 0) AS symbols, coalesce(n_marks * 1000 // nullif(n_words, 0), 0) AS marks,
    coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS dup_lines, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeats
  FROM m),
long AS (UNPIVOT (SELECT s.*, g.good FROM s JOIN (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) g
  ON s.doc_id = g.doc_id WHERE NOT base_failed) ON symbols, marks, dup_lines, repeats INTO NAME rule VALUE score),
c AS (
  SELECT stratum, rule, cutoff, sum((good = 1)::INT)::DOUBLE AS n, sum((good = 1 AND score > cutoff)::INT)::DOUBLE AS k,
    sum((good = 0)::INT) AS n_bad, sum((good = 0 AND score > cutoff)::INT) AS bad
  FROM long, (SELECT unnest([0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700, 1000, 1500, 2000]) AS cutoff) GROUP BY ALL),
p AS (
  SELECT *, count(*) OVER () AS tests, CASE WHEN k >= n * 0.0125 THEN 1 ELSE list_sum(list_transform(range(0, k::BIGINT + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1.0) - lgamma(n - j + 1) + j * ln(0.0125) + (n - j) * ln(0.9875)))) END AS p FROM c),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM p WHERE p <= 0.05 / tests AND bad > 0 AND bad >= 3 * 0.0125 * n_bad GROUP BY ALL),
wide AS (
  SELECT stratum, min(cutoff) FILTER (rule = 'symbols') AS a, min(cutoff) FILTER (rule = 'marks') AS b,
    min(cutoff) FILTER (rule = 'dup_lines') AS c, min(cutoff) FILTER (rule = 'repeats') AS d FROM cut GROUP BY stratum)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(symbols > a, false) OR coalesce(marks > b, false) OR coalesce(dup_lines > c, false)
    OR coalesce(repeats > d, false)) AS kept
FROM s LEFT JOIN wide ON s.stratum IS NOT DISTINCT FROM wide.stratum
"""

ORACLE_SQL["op8_minhash_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS v, doc_id AS to_id FROM d UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.to_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(to_id) AS c FROM reach GROUP BY v) r ON r.v = d.doc_id
"""

ORACLE_SQL["op3_mix_sources"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words FROM documents),
s AS (SELECT source, sum(n_words)::DOUBLE AS t FROM d GROUP BY source),
g AS (SELECT list(t) AS ts, sum(t) AS total, min(t) AS least, ln(count(*)::DOUBLE) * 0.98 AS goal FROM s WHERE t > 0),
b AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
  UNION ALL
  SELECT i + 1, if(e >= goal, (lo + hi) / 2, lo), if(e >= goal, hi, (lo + hi) / 2),
    if(r > 4, (lo2 + hi2) / 2, lo2), if(r > 4, hi2, (lo2 + hi2) / 2)
  FROM (
    SELECT *, ln(list_sum(list_transform(ts, lambda t: t ** ((lo + hi) / 2))))
        - list_sum(list_transform(ts, lambda t: t ** ((lo + hi) / 2) * ((lo + hi) / 2) * ln(t))) / list_sum(list_transform(ts, lambda t: t ** ((lo + hi) / 2))) AS e,
      total * least ** ((lo2 + hi2) / 2 - 1) / list_sum(list_transform(ts, lambda t: t ** ((lo2 + hi2) / 2))) AS r
    FROM b, g WHERE i < 50)),
x AS (
  SELECT *, list_sum(list_transform(ts, lambda t: t ** x)) AS z FROM (
    SELECT ts, total, greatest(
      if(ln(list_sum(ts)) - list_sum(list_transform(ts, lambda t: t * ln(t))) / list_sum(ts) >= goal, 1.0, lo),
      if(total / least / len(ts) <= 4, 0.0, hi2)) AS x
    FROM b, g WHERE i = 50)),
p AS (SELECT source, t, floor(t ** x / z * total + 1e-6) AS budget FROM s, x WHERE t > 0),
q AS (SELECT source, floor(budget / t)::BIGINT AS blocks, budget - floor(budget / t) * t AS rest FROM p
      UNION ALL SELECT source, 1, 0 FROM s WHERE t = 0),
r AS (
  SELECT d.*, blocks, rest, sum(n_words) OVER (PARTITION BY d.source ORDER BY md5('mix/' || blocks || '/' || d.doc_id)) AS run
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, n_words::BIGINT AS n_words, unnest(range(0, blocks + if(run <= rest AND rest > 0, 1, 0))) AS block FROM r
"""
