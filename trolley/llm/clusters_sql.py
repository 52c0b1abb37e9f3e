"""Clustering in DuckDB: every vector with every centroid, round after round."""

from __future__ import annotations


def cluster_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT ROW_NUMBER() OVER () AS r, vec_id,
                   list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = {dims}
              AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dims}
        )""",
        f"""parts AS MATERIALIZED (
            SELECT r, UNNEST(v) AS x, UNNEST(range({dims})) AS d FROM kept
        )""",
        f"""centroids0 AS MATERIALIZED (
            SELECT c, UNNEST(v) AS place, UNNEST(range({dims})) AS d
            FROM (
                SELECT v, ROW_NUMBER() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c
                FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k}
            )
        )""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
            SELECT r, c, distance
            FROM (
                SELECT r, c, CAST(SUM((x - place) * (x - place)) AS BIGINT) AS distance
                FROM parts JOIN centroids{i} USING (d) GROUP BY r, c
            )
            QUALIFY ROW_NUMBER() OVER (PARTITION BY r ORDER BY distance, c) = 1
        )""")
        if i < rounds:
            steps.append(f"""centroids{i + 1} AS MATERIALIZED (
            SELECT c, CAST((total - ((total % n) + n) % n) // n AS BIGINT) AS place, d
            FROM (
                SELECT c, d, SUM(x) AS total, COUNT(*) AS n
                FROM parts JOIN near{i} USING (r) GROUP BY c, d
            )
            UNION ALL
            SELECT c, place, d FROM centroids{i} WHERE c NOT IN (SELECT c FROM near{i})
        )""")
    joined = ",\n".join(steps)
    return f"""
        WITH {joined},
        digests AS (
            SELECT c, sha256(string_agg(CAST(place AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256
            FROM centroids{rounds} GROUP BY c
        )
        SELECT vec_id, CAST(c AS INT) AS cluster, distance,
               CAST(SUM(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(SUM(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM near{rounds} JOIN kept USING (r) JOIN digests USING (c)"""
