"""Windows are cut and packed in one Python worker of a task, which remembers words."""

from __future__ import annotations

import numpy as np
import pytest

from tests.llm.conftest import EDGES, frame
from tests.llm.test_packed_windows import texts
from trolley.llm import lm
from trolley.llm.hashing import WordHasher, hash_long, word_bounds
from trolley.llm.queries import BYTE_PIECES


def test_a_task_packs_windows_in_one_worker(spark, monkeypatch):
    plans = {}

    def staged(df, name, function=lm.staged):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return function(df, name)

    monkeypatch.setattr(lm, "staged", staged)
    docs = frame(spark, texts(40))
    assert lm.score(docs, lm.read_ranks(BYTE_PIECES)).count() == 40
    # One packs what it cuts from texts, and one merges the packs of a part.
    assert plans["windows"].count("MapInArrow") == 2


@pytest.mark.parametrize("rows", [texts(90), [*EDGES, *texts(30), *texts(30), (None, None), (None, "a b")]])
def test_packs_of_documents_are_those_of_window_rows(spark, monkeypatch, rows):
    of_id = np.uint16
    ranks = spark.sparkContext.broadcast(lm.read_ranks(BYTE_PIECES))
    docs = frame(spark, rows).repartition(3)
    samples = lm.gathered(docs, ranks, count=False)
    expected = lm.packed(samples, 5, of_id).collect()
    found = lm.packed(docs, 5, of_id, ranks).collect()
    assert sorted((r.n, bytes(r.ids)) for r in found) == sorted((r.n, bytes(r.ids)) for r in expected)
    assert len(found) > 1


def test_hashes_of_numbers_are_those_of_the_engine(spark):
    keys = np.array([0, 1, -1, 42, 2**31, -(2**31), 2**63 - 1, -(2**63)], np.int64)
    rows = spark.createDataFrame([(int(k),) for k in keys], "key long").selectExpr("hash(key) AS h").collect()
    assert [r.h for r in rows] == hash_long(keys).tolist()


def test_a_worker_keeps_common_words_and_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(lm, "REMEMBERED", 60)
    ranks, rng = lm.read_ranks(BYTE_PIECES), np.random.default_rng(2)
    kept = lm.Subwords.of(ranks)
    assert lm.Subwords.of(ranks) is kept
    hasher, most = WordHasher(), 0
    for _ in range(30):
        common = [f"common{i}" for i in range(rng.integers(0, 40))]
        rare = ["".join(rng.choice(list("abcdefghé"), 7)) for _ in range(rng.integers(0, 30))]
        text = " ".join(rng.permutation(common + rare)).encode()
        data = np.frombuffer(text, np.uint8)
        starts, ends, rows = word_bounds(data, np.array([0, len(text) // 2, len(text)]))
        chunk = data, starts, ends, hasher(data, starts, ends), rows
        for a, b in zip(kept(*chunk), lm.Subwords(ranks)(*chunk), strict=True):
            assert a.tolist() == b.tolist()
        most = max(most, len(kept._keys))
    assert 60 < most <= 60 + 70
