"""Removal of repeated passages in DuckDB SQL, by the same rule."""

from trolley.llm.shared_passages import LEAST, REACH

REMOVE_SHARED_SQL = rf"""WITH tokens AS (
    SELECT doc_id, UNNEST(t) AS token, generate_subscripts(t, 1) AS i
    FROM (
        SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
        FROM documents WHERE text IS NOT NULL
    )
),
placed AS (
    SELECT *, CAST(SUM(length(token)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS until,
           token ~ '[\x20\x09-\x0D]+' AS gap,
           LEAD(token) OVER (PARTITION BY doc_id ORDER BY i) AS next_token
    FROM tokens
),
words AS (
    SELECT doc_id, i, until - length(token) AS since, until,
           translate(token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word,
           next_token IS NULL OR contains(next_token, chr(10)) OR i = MAX(i) OVER (PARTITION BY doc_id) AS last,
           (7 * strlen(token)
            + 11 * COALESCE(LEAD(strlen(token)) OVER (PARTITION BY doc_id ORDER BY i), 0)
            + 13 * COALESCE(LAG(strlen(token)) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 31 AS number
    FROM placed WHERE NOT gap
),
cut AS (
    SELECT *, last
           OR (number < COALESCE(MIN(number) OVER (PARTITION BY doc_id ORDER BY i
                   ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING), 99)
               AND number <= COALESCE(MIN(number) OVER (PARTITION BY doc_id ORDER BY i
                   ROWS BETWEEN 1 FOLLOWING AND {REACH} FOLLOWING), 99)) AS ends
    FROM words
),
numbered AS (
    SELECT *, COALESCE(SUM(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit
    FROM cut
),
units AS (
    SELECT doc_id, unit, string_agg(word, ' ' ORDER BY i) AS body, COUNT(*) AS n,
           MIN(since) AS since, MAX(until) AS until
    FROM numbered GROUP BY doc_id, unit
),
judged AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY body ORDER BY doc_id, unit) > 1 AS again FROM units
),
islands AS (
    SELECT *, unit - ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY unit) AS island
    FROM judged WHERE again
),
spans AS (
    SELECT doc_id, MIN(since) AS since, MAX(until) AS until
    FROM islands GROUP BY doc_id, island HAVING SUM(n) >= {LEAST}
),
kept AS (
    SELECT p.doc_id, string_agg(p.token, '' ORDER BY p.i) AS text
    FROM placed AS p
    LEFT JOIN spans AS s
      ON p.doc_id = s.doc_id AND p.until > s.since AND p.until <= s.until
    WHERE s.doc_id IS NULL
    GROUP BY p.doc_id
),
listed AS (
    SELECT doc_id, COUNT(*) AS n_removed,
           string_agg(since::BIGINT || ':' || until::BIGINT, ' ' ORDER BY since) AS removed_spans
    FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN COALESCE(kept.text, '') END AS text,
       COALESCE(n_removed, 0) AS n_removed, COALESCE(removed_spans, '') AS removed_spans
FROM documents AS d
LEFT JOIN kept USING (doc_id) LEFT JOIN listed USING (doc_id)"""
