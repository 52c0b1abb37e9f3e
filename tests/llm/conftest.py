from __future__ import annotations

import pytest

#: Extra columns with names that the operators use themselves.
DOCS = (
    "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, row INT, key STRING, "
    "digest STRING, _id STRING, _key STRING, size STRING, start STRING, shard INT, score DOUBLE"
)
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
EDGES = [
    (1, "one two three four five six seven"),
    (2, "one two three four five six seven"),
    (9, "one two three four five six seven"),
    (3, None),
    (4, ""),
    (5, " \n \t"),
    (6, "x" * 120_000),
    (7, LONG),
    (8, LONG + " more"),
    (8, LONG + " more"),
    (10, "é日本 🙂 naïve \x01 Ünï"),
    (11, "single"),
    (None, "a text without an id of some words"),
]


def frame(spark, rows):
    """Documents of (id, text) or (id, text, source)."""
    full = []
    for i, (doc_id, text, *source) in enumerate(rows):
        of = source[0] if source else (None if i % 5 == 4 else f"src{i % 3}")
        full.append((doc_id, text, "en", of, None, i, "k", None, "x", "y", "z", None, 1, 0.5))
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
