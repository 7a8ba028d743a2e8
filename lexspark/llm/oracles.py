"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

SUBSTRING = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, greatest(len(ws) - 19 + 1, 1))) AS pos, ws FROM w
), g AS (
  SELECT doc_id, pos, md5(array_to_string(ws[pos:pos + 19], ' ')) AS h FROM p
), f AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS rn FROM g
), r AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM f WHERE rn > 1
), e AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w
), k AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) FILTER (r.pos IS NULL) AS kept, count(r.pos) AS n_removed
  FROM e LEFT JOIN r USING (doc_id, pos) GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

#: Shares of word characters inside n-grams that a text holds twice, for each n, with their limits.
LIMITS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
REPETITION = (
    r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w
), g AS (
  SELECT doc_id, n, pos, count(*) OVER (PARTITION BY doc_id, n, gram) AS times FROM (
    SELECT doc_id, n, pos, array_to_string(ws[pos:pos + n - 1], ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS pos FROM w, range(5, 11) r(n)))
), c AS (
  SELECT doc_id, n, count(*) AS words, sum(length(word)) AS chars FROM (SELECT DISTINCT doc_id, n, unnest(range(pos, pos + n)) AS pos FROM g WHERE times > 1) JOIN t USING (doc_id, pos) GROUP BY doc_id, n
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w
), d AS (
  SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce((SELECT words FROM c WHERE c.doc_id = w.doc_id AND c.n = 5), 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(d.chars, 0) AS DOUBLE) AS dup_chars, """
    + ", ".join(f"CAST(coalesce((SELECT chars FROM c WHERE c.doc_id = w.doc_id AND c.n = {n}), 0) AS DOUBLE) AS c{n}" for n in LIMITS)
    + """ FROM w LEFT JOIN d USING (doc_id)
), s AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, dup_chars / greatest(word_chars, 1) AS dup_line_share, """
    + ", ".join(f"c{n} / greatest(word_chars, 1) AS dup_{n}gram_share" for n in LIMITS)
    + """ FROM m
)
SELECT *, NOT base_failed AND dup_line_share <= 0.20 AND """
    + " AND ".join(f"dup_{n}gram_share <= {x}" for n, x in LIMITS.items())
    + " AS kept FROM s"
)

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT item_id, least(len(ws), 8) AS n, ws, unnest(range(1, len(ws) - least(len(ws), 8) + 2)) AS pos FROM b WHERE len(ws) > 0
), bg AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[pos:pos + n - 1], ' ') AS gram FROM bw
), dp AS (
  SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM bg)
), h AS (
  SELECT doc_id, pos, dp.n, item_id FROM (SELECT doc_id, pos, n, array_to_string(ws[pos:pos + n - 1], ' ') AS gram FROM dp) dp JOIN bg ON bg.n = dp.n AND bg.gram = dp.gram
), c AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
