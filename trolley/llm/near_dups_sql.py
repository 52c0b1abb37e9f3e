"""Near duplicates in DuckDB SQL: all pairs that share a shingle, for small tables."""

NEAR_DUPLICATES_SQL = r"""WITH RECURSIVE
classes AS (
    SELECT COALESCE(text, '') AS body, MIN(doc_id) AS class_id, COUNT(*) AS class_size
    FROM documents GROUP BY ALL
),
words AS (
    SELECT class_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM classes
),
shingles AS (
    SELECT DISTINCT class_id, UNNEST(CASE
        WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
    FROM words
),
sizes AS (SELECT class_id, COUNT(*) AS n FROM shingles GROUP BY class_id),
common AS (
    SELECT a.class_id AS x, b.class_id AS y, COUNT(*) AS k
    FROM shingles AS a JOIN shingles AS b USING (g)
    WHERE a.class_id <> b.class_id GROUP BY ALL
),
links AS (
    SELECT x, y FROM common
    JOIN sizes AS a ON a.class_id = x JOIN sizes AS b ON b.class_id = y
    WHERE k / (a.n + b.n - k) >= 0.8
),
reached(x, root) AS (
    SELECT class_id, class_id FROM classes
    UNION
    SELECT y, root FROM reached JOIN links USING (x) WHERE root < y
),
groups AS (SELECT x, MIN(root) AS group_id FROM reached GROUP BY x),
counted AS (
    SELECT x, COUNT(*) AS n, SUM(class_size) AS of
    FROM links JOIN classes ON class_id = y GROUP BY x
)
SELECT doc_id, class_id, class_size, COALESCE(n, 0) AS n_links,
       CAST(COALESCE(of, 0) AS BIGINT) AS n_linked_rows, group_id
FROM documents JOIN classes ON COALESCE(text, '') = body
JOIN groups ON groups.x = class_id LEFT JOIN counted ON counted.x = class_id"""
