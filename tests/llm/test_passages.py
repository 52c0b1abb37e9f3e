"""Repeated passages against brute force over all windows."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

import __spark_entry__ as driver
from tests.llm.conftest import EDGES, LONG, frame
from tests.llm.test_dedup import key
from trolley.llm import passages


def by_hand(rows, passage, least):
    gone, windows, lines, places = defaultdict(set), defaultdict(list), set(), {}
    words_gone = defaultdict(set)
    for doc in sorted({row for row in rows if row[1] is not None}, key=lambda r: (key(r[0]), r[1])):
        at = 0
        for line in doc[1].split("\n"):
            end = at + len(line) + (at + len(line) < len(doc[1]))
            words = tuple(line.encode().lower().split())
            if len(words) >= least and words in lines:
                gone[doc].update(range(at, end))
            elif len(words) >= least:
                lines.add(words)
            at = end
        places[doc] = [m.span() for m in re.finditer(r"[^ \t-\r]+", doc[1])]
        words = doc[1].encode().lower().split()
        for p in range(len(words) - passage + 1):
            windows[tuple(words[p : p + passage])].append((doc, p))
    for (first, place), *others in windows.values():
        for doc, p in others:
            start = max(p, place + passage) if doc == first else p
            words_gone[doc].update(range(start, p + passage))
    for doc, found in words_gone.items():
        for i in found:
            start, end = places[doc][i]
            gone[doc].update(range(start, places[doc][i + 1][0] if i + 1 in found else end))
    return sorted(
        (
            (doc[0], doc[1] and "".join(c for i, c in enumerate(doc[1]) if i not in gone[doc]))
            for doc in rows
        ),
        key=repr,
    )


def found_by(spark, rows, *args):
    found = passages.remove_passages(frame(spark, rows), *args).collect()
    for r in found:
        ends = [i for span in r.removed for i in span]
        assert ends == sorted(set(ends))
    return sorted(((r.doc_id, r.text) for r in found), key=repr)


PASSAGE = " ".join(f"wörd{i} Some" for i in range(30))
MIXED = [
    (20, f"start of one {PASSAGE} and its end"),
    (21, f"another text with\n{PASSAGE.upper().replace('Ö', 'ö')} \t then goes on, quite long"),
    (22, " ".join(["tick"] * 140)),
    (23, "x y z " * 40),
    (24, "before " + " ".join(f"wörd{i} Some" for i in range(2, 26)) + " after"),
    (25, "before " + " ".join(f"wörd{i} Some" for i in range(2, 28)) + " after"),
    (25, "before " + " ".join(f"wörd{i} Some" for i in range(2, 28)) + " after"),
]


@pytest.mark.parametrize(("passage", "least"), [(50, 5), (50, 1), (6, 5), (7, 1)])
def test_passages_by_hand(spark, passage, least):
    rows = EDGES[3:7] + EDGES[10:] + MIXED
    assert found_by(spark, rows, passage, least) == by_hand(rows, passage, least)


@pytest.mark.parametrize("passage", [2, 3, 8])
def test_passages_of_few_words(spark, passage):
    rng = random.Random(passage)
    rows = [
        (i, "".join(rng.choice("abc") + rng.choice("   \n") for _ in range(rng.randrange(60))))
        for i in range(60)
    ]
    assert found_by(spark, rows, passage, 3) == by_hand(rows, passage, 3)


def test_long_and_no_texts(spark, nothing):
    rows = [(1, LONG), (2, LONG + " more"), (2, LONG + " more"), (3, "own words " + LONG)]
    found = dict(found_by(spark, rows))
    assert found == {1: LONG, 2: " more", 3: "own words "}
    assert passages.remove_passages(nothing).count() == 0


def test_passage_within_a_line_in_the_registered_query(spark, tmp_path):
    rows = [(i, f"{t} " + PASSAGE + f" {t} {i}") for i, t in enumerate(("first", "second"))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = driver.queries()["op10_passage_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in found} == {0: rows[0][1], 1: "second  second 1"}


def test_short_lines_in_the_registered_query(spark, tmp_path):
    rows = [(1, "menu\nthe first text\n\nread more"), (2, "Menu\n\nthe second text\nread  more")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = driver.queries()["op10_passage_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in found} == {1: rows[0][1], 2: "\nthe second text\n"}
