"""The judgement of URLs in DuckDB SQL, written from the same definitions.

The text has a fixed number of levels, ``DEPTH``; a level is left empty unless some node of the one
before has enough pages with a further segment, as in the tree, whose depth has no bound.
"""

from __future__ import annotations

from trolley.llm.url_filters import (
    BLOCK_FROM,
    LEVELS,
    MIN_PAGES,
    SIMILAR,
    UPPER,
    WEIGHT,
)

DEPTH = 12

RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}


def _rule_cases(rules: dict[str, str], verdict: bool) -> str:
    cases = []
    for text in sorted(rules, key=lambda r: (len(r), r), reverse=True):
        of, slash, start = text.partition("/")
        then = rules[text] if verdict else text
        cases.append(
            f"WHEN (host = '{of}' OR suffix(host, '.{of}')) "
            f"AND starts_with(path, '{slash}{start}') THEN '{then}'"
        )
    return f"CASE {' '.join(cases)} END"


def judge_urls_sql(rules: dict[str, str] = RULES) -> str:
    cut = [
        f"""parsed AS (
            SELECT page_id, CASE WHEN position('://' IN url) > 0
                   THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
            FROM pages
        ),
        known AS (
            SELECT doc_id AS page_id, MAX(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END)
                   AS bad
            FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id
        ),
        split AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}')
                       AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM parsed
        ),
        t0 AS (
            SELECT split.*, bad, {", ".join(
                f"COALESCE(list_filter(string_split(path, '/'), lambda s: s <> '')[{k}], '')"
                f" AS t{k}" for k in range(1, DEPTH + 1))}
            FROM split LEFT JOIN known USING (page_id)
        )"""
    ]
    for k in range(1, DEPTH + 1):
        parent = ", ".join(["host", *(f"t{i}" for i in range(1, k))])
        deep = "TRUE" if k <= LEVELS else f"""EXISTS (
                SELECT 1 FROM t{k - 1} WHERE t{k} <> '' GROUP BY {parent} HAVING COUNT(*) >= {MIN_PAGES})"""
        cut.append(f"""t{k} AS MATERIALIZED (
            SELECT * REPLACE (CASE
                WHEN t{k} = '' OR NOT {deep} THEN ''
                WHEN COUNT(*) OVER (PARTITION BY {parent}, t{k}) >= {MIN_PAGES}
                THEN t{k} ELSE '*' END AS t{k})
            FROM t{k - 1}
        )""")
    cut.append(f"""overall AS (
            SELECT COALESCE(SUM(bad)::DOUBLE / NULLIF(COUNT(bad), 0), 0.0) AS g FROM t{DEPTH}
        ),
        m0 AS (
            SELECT *, {", ".join(f"t{k} AS m{k}" for k in range(1, DEPTH + 1))}
            FROM t{DEPTH}
        )""")
    for k in range(1, DEPTH + 1):
        parent = ", ".join(["host", *(f"m{i}" for i in range(1, k))])
        own, all_ = f"OVER (PARTITION BY {parent}, m{k})", f"OVER (PARTITION BY {parent})"
        cut.append(f"""c{k} AS (
            SELECT *, COUNT(bad) {own} AS n, COALESCE(SUM(bad) {own}, 0)::DOUBLE AS b,
                   (COALESCE(SUM(bad) {all_}, 0) + {WEIGHT}::DOUBLE * g)
                       / (COUNT(bad) {all_} + {WEIGHT}::DOUBLE) AS p
            FROM m{k - 1}, overall
        ),
        m{k} AS MATERIALIZED (
            SELECT * EXCLUDE (n, b, p, g) REPLACE (CASE
                WHEN m{k} = '' THEN ''
                WHEN n > 0 AND abs(b / n - p) > {SIMILAR}::DOUBLE * sqrt(p * (1 - p) / n)
                THEN m{k} ELSE '*' END AS m{k})
            FROM c{k}
        )""")
    node = ", ".join(["host", *(f"m{k}" for k in range(1, DEPTH + 1))])
    cut.append(f"""hosts AS (
            SELECT *, (COALESCE(SUM(bad) OVER (PARTITION BY host), 0) + {WEIGHT}::DOUBLE * g)
                       / (COUNT(bad) OVER (PARTITION BY host) + {WEIGHT}::DOUBLE) AS h
            FROM m{DEPTH}, overall
        ),
        scored AS (
            SELECT *, (COALESCE(SUM(bad) OVER (PARTITION BY {node}), 0) + {WEIGHT}::DOUBLE * h)
                       / (COUNT(bad) OVER (PARTITION BY {node}) + {WEIGHT}::DOUBLE) AS badness
            FROM hosts
        )""")
    template = ", ".join(
        f"m{k}" if k <= LEVELS else f"NULLIF(m{k}, '')" for k in range(1, DEPTH + 1)
    )
    return f"""WITH {", ".join(cut)}
        SELECT page_id, host, path, {_rule_cases(rules, False)} AS rule,
               COALESCE({_rule_cases(rules, True)},
                        CASE WHEN badness >= {BLOCK_FROM}::DOUBLE THEN 'block' ELSE 'allow' END)
                   AS verdict,
               concat_ws('/', host, {template}) AS template, ROUND(badness, 9) AS badness
        FROM scored"""
