"""Removal of repeated lines in DuckDB SQL."""

REMOVE_REPEATS_SQL = r"""WITH lines AS (
    SELECT doc_id, text, UNNEST(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS i,
           len(string_split(text, chr(10))) AS n
    FROM documents
),
placed AS (
    SELECT *, line || CASE WHEN i < n THEN chr(10) ELSE '' END AS unit,
           regexp_extract_all(
               translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS words
    FROM lines
),
judged AS (
    SELECT *, SUM(length(unit)) OVER (PARTITION BY doc_id ORDER BY i) AS until,
           len(words) >= 1 AND ROW_NUMBER() OVER (
               PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, i) > 1 AS gone
    FROM placed
)
SELECT doc_id, COALESCE(string_agg(unit, '' ORDER BY i) FILTER (NOT gone), '') AS text,
       COUNT(*) FILTER (gone) AS n_removed,
       COALESCE(string_agg((until - length(unit))::BIGINT || ':' || until::BIGINT, ' ' ORDER BY i)
           FILTER (gone), '') AS removed_spans
FROM judged GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, '' FROM documents WHERE text IS NULL"""
