"""Equivalent DuckDB SQL of the queries that SQL can express."""

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_matches(role || chr(1) || text, '\[INST\]|\[/INST\]|</s>|&lt;|&#91;|&amp;') AS odd FROM rows),
sized AS (
  SELECT *, length(role || text) + 17
    + CASE WHEN odd THEN 4 * (length(role || text) - length(replace(role || text, '&', '')))
                       + 4 * (length(role || text) - length(replace(role || text, '[', '')))
                       + 3 * (length(role || text) - length(replace(role || text, '<', ''))) ELSE 0 END AS chars
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_loss_spans,
  true AS round_trip
FROM sized GROUP BY conv_id
"""

RULES_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
windows AS (
  SELECT r, i, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS g, lead(w, 4) OVER p AS fifth
  FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows WHERE fifth IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM repeated, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
counted AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM words GROUP BY r),
lines AS (
  SELECT r, host, x, trim(regexp_replace(lower(x), '[0-9]', '0', 'g'), ' ') AS h
  FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
perdoc AS (SELECT r, (count(*) - count(DISTINCT x))::BIGINT AS n_dup_lines, sum(length(h))::BIGINT AS line_chars FROM lines GROUP BY r),
frequent AS (SELECT host, h FROM lines JOIN (SELECT r, text FROM docs) USING (r) GROUP BY host, h HAVING count(DISTINCT md5(text)) > 2),
removed AS (
  SELECT r, count(*) AS removed_lines, sum(length(l.h))::BIGINT AS removed_chars FROM lines l
  JOIN frequent f ON l.host IS NOT DISTINCT FROM f.host AND l.h = f.h GROUP BY r),
whole AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_chars, 0) AS removed_chars, coalesce(line_chars, 0) AS line_chars
  FROM docs LEFT JOIN counted USING (r) LEFT JOIN covered USING (r) LEFT JOIN perdoc USING (r) LEFT JOIN removed USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
  NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AND NOT removed_chars * 100 > line_chars * 75 AS kept,
  removed_lines, removed_chars, line_chars
FROM whole
"""

LINES_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, ('0x' || substr(md5(text), 1, 15))::BIGINT NULLS FIRST) AS r, doc_id, text, string_split(text, chr(10)) AS lines
  FROM documents),
every AS (SELECT r, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i FROM docs),
spoken AS (SELECT r, x, i, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS k FROM every WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT r, k, x AS a, lead(x, 1) OVER p AS b, lead(x, 2) OVER p AS c FROM spoken WINDOW p AS (PARTITION BY r ORDER BY k)),
later AS (
  SELECT r, k FROM (
    SELECT r, k, row_number() OVER (PARTITION BY a, b, c ORDER BY r, k) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT s.r, s.i FROM later l JOIN spoken s ON s.r = l.r AND s.k BETWEEN l.k AND l.k + 2),
cut AS (SELECT r, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS removed FROM gone GROUP BY r),
rest AS (
  SELECT e.r, string_agg(x, chr(10) ORDER BY e.i) AS text FROM every e
  LEFT JOIN gone g ON e.r = g.r AND e.i = g.i WHERE g.i IS NULL GROUP BY e.r)
SELECT d.doc_id, coalesce(len(d.lines), 0) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed_lines,
  sha256(coalesce(rest.text, '')) AS text_sha256
FROM docs d LEFT JOIN cut USING (r) LEFT JOIN rest USING (r)
"""
