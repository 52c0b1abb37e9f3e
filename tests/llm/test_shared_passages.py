"""Removal of repeated passages against plain loops, and on passages put into texts."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, frame
from trolley.llm.filters import MOST_BITMAPS, bitmaps_for, split_by_filter
from trolley.llm.shared_passages import LEAST, REACH, remove_shared

SPACE = " \t\n\v\f\r"


def words_of(text):
    """(lower word, start, end, line) by characters."""
    out, at, line = [], 0, 0
    while at < len(text):
        if text[at] in SPACE:
            line += text[at] == "\n"
            at += 1
            continue
        end = at
        while end < len(text) and text[end] not in SPACE:
            end += 1
        word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[at:end])
        out.append((word, at, end, line))
        at = end
    return out


def units_of(text):
    words = words_of(text)
    size = [len(w.encode()) for w, *_ in words]
    get = lambda j: size[j] if 0 <= j < len(size) else 0
    number = [(7 * get(j) + 11 * get(j + 1) + 13 * get(j - 1)) % 31 for j in range(len(words))]
    out, start = [], 0
    for j in range(len(words)):
        last = j + 1 == len(words) or words[j + 1][3] != words[j][3]
        low = all(number[j] < number[i] for i in range(max(0, j - REACH), j)) and all(
            number[j] <= number[i] for i in range(j + 1, min(len(words), j + REACH + 1))
        )
        if last or low:
            part = words[start : j + 1]
            out.append((tuple(w for w, *_ in part), part[0][1], part[-1][2]))
            start = j + 1
    return out


def by_hand(rows, least=LEAST):
    """For each row its text without the spans, and the spans."""
    texts = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: r[:2])
    seen, gone = set(), defaultdict(list)
    for here, i, text in texts:
        run = []
        for unit in [*units_of(text), None]:
            if unit is not None and unit[0] in seen:
                run.append(unit)
                continue
            if sum(len(w) for w, *_ in run) >= least:
                gone[here, i, text].append((run[0][1], run[-1][2]))
            run = []
            if unit is not None:
                seen.add(unit[0])
    out = []
    for i, text in rows:
        spans = gone.get((i is not None, i or 0, text), [])
        kept, at = "", 0
        for start, end in spans:
            kept += text[at:start]
            at = end
        out.append((i, None if text is None else kept + text[at:], tuple(spans)))
    return sorted(out, key=repr)


def found(df):
    return sorted(
        ((r.doc_id, r.text, tuple((s.start, s.end) for s in r.removed)) for r in df.collect()), key=repr
    )


def prose(rng, n):
    vocabulary = [rng.choice("bcdfgh") * rng.randint(0, 3) + rng.choice("aeiou") * rng.randint(1, 6) for _ in range(400)]
    return [rng.choice(vocabulary) for _ in range(n)]


def lined(rng, words):
    return "".join(w + rng.choice([" ", " ", " ", " ", " ", "  ", "\n"]) for w in words)


@pytest.fixture(scope="module")
def planted():
    """Texts of which some share passages of 55 to 120 words, put in anywhere."""
    rng = random.Random(4)
    passages = [" ".join(prose(rng, rng.randint(55, 120))) for _ in range(12)]
    rows = []
    for i in range(150):
        text = lined(rng, prose(rng, rng.randint(20, 300)))
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            at = text.find(" ", at) + 1 or len(text)
            text = f"{text[:at]} {rng.choice(passages)} {text[at:]}"
        rows.append((i, text))
    return rows


def test_planted_passages(spark, planted):
    rows = found(remove_shared(frame(spark, planted)))
    assert rows == by_hand(planted)
    removed = {i: spans for i, _, spans in rows}
    dirty = {i for i, _ in planted if i % 3 == 0}
    assert all(not spans for i, spans in removed.items() if i not in dirty)
    assert sum(bool(removed[i]) for i in dirty) >= len(dirty) - 12


def test_awkward_rows(spark, nothing):
    long = next(t for i, t in EDGES if i == 7)
    rows = [*EDGES, (20, long[:5000]), (21, f"before {long[9000:12000].upper()} after"), (22, "\n\n".join(["a b c"] * 90))]
    assert found(remove_shared(frame(spark, rows))) == by_hand(rows)
    assert remove_shared(nothing).collect() == []


def test_short_phrases_and_lines_stay(spark):
    rng = random.Random(9)
    line = " ".join(prose(rng, 20))
    rows = [(i, f"{' '.join(prose(rng, 30))}\n{line}\n{' '.join(prose(rng, 30))}") for i in range(20)]
    assert all(not r.removed for r in remove_shared(frame(spark, rows)).collect())
    assert any(r.removed for r in remove_shared(frame(spark, rows), least=10).collect())


def test_rows_that_share_an_id(spark):
    rng = random.Random(11)
    passage = " ".join(prose(rng, 90))
    rows = [(1, f"x {passage}"), (1, f"y {passage}"), (1, f"y {passage}"), (None, f"z {passage}")]
    result = remove_shared(frame(spark, rows)).collect()
    assert sum(not r.removed for r in result) == 1
    assert next(r for r in result if not r.removed).doc_id is None


def test_filter_splits_rows(spark):
    df = spark.range(5000).select("id", (F.col("id") % 97).alias("key"))
    members = spark.range(10).select(F.col("id").alias("key"))
    inside, outside = split_by_filter(df, members, "key")
    assert inside.count() + outside.count() == 5000
    assert inside.where("key < 10").count() == df.where("key < 10").count()
    assert outside.count() > 4000
    none, all_rows = split_by_filter(df, members.where("false"), "key")
    assert (none.count(), all_rows.count()) == (0, 5000)
    assert bitmaps_for(0) == bitmaps_for(1000) == 256 < bitmaps_for(10**7) < bitmaps_for(10**12) == MOST_BITMAPS
