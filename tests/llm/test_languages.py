"""Language identification: held-out accuracy, scores by plain loops, and awkward rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trolley.llm import languages
from trolley.llm.languages import Model, calibrate, fit, predict, subwords, train
from trolley.llm.queries import op13_language

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    return fit(docs.where("pmod(crc32(cast(doc_id as string)), 4) <> 2"))


def plain_subwords(word: bytes):
    """All subwords of one word, by the definition."""
    padded = b" " + word + b" "
    return [
        padded[i : i + n] for n in range(2, 6) for i in range(len(padded) - n + 1)
    ]


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    found = op13_language(spark, ROOT).collect()
    assert len(found) == len(docs)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    told = [r for r in held if r.lang_pred != "und"]
    right = [r for r in told if r.lang_pred == docs[r.doc_id].lang]
    assert len(right) >= 0.97 * len(told)
    accepted = [r for r in told if not r.rejected]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in accepted) >= 0.97 * len(accepted)
    assert all(0 <= r.score <= 1 for r in found)
    assert all((r.lang_pred == "und") == (r.score == 0) for r in found)


def test_subwords_of_words():
    data = np.frombuffer("ab  straße".encode(), np.uint8)
    found, counts = subwords(data, np.array([0, 4]), np.array([2, len(data)]))
    words = [b"ab", "straße".encode()]
    assert counts.tolist() == [1 + len(plain_subwords(w)) for w in words]
    # Equal subwords have equal buckets, others nearly always differ.
    all_of = [[w, *plain_subwords(w)] for w in words]
    assert len(set(found.tolist())) == len({b for w in all_of for b in w}) or len(
        set(found.tolist())
    ) >= len({b for w in all_of for b in w}) - 1


def test_scores_by_plain_loops(model):
    """A text's score from one word after another."""
    text = "The cat, the 2 hats; über die Brücke el niño"
    words = []
    for run in "".join(c if c.isalpha() else " " for c in text).split():
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in run.encode())
        words.append(raw)
    total, n = np.zeros(len(model.languages)), 0
    for raw in words:
        found, counts = subwords(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
        for b in found.tolist():
            total += model.table[b]
        n += int(counts[0])
    logits = (total / n + model.bias) / model.temperature
    p = [math.exp(x - max(logits)) for x in logits]
    (batch,) = model.logits(pa.array([text]))
    assert model.probabilities(batch)[0] == pytest.approx([x / sum(p) for x in p], abs=1e-6)


def test_words_do_not_run_over_texts(model):
    texts = ["ein Haus", "und noch", None, "", "end", "le soir"]
    together = np.concatenate(list(model.logits(pa.array(texts))))
    alone = np.concatenate([next(model.logits(pa.array([t], pa.string()))) for t in texts])
    assert together == pytest.approx(alone, abs=1e-9)


def test_awkward_rows(spark, edges, model):
    rows = predict(edges, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in edges.collect())
    by_id = {r.doc_id: r for r in rows}
    for i in (3, 4, 5):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert all(by_id[i].lang_pred in model.languages for i in (1, 6, 7, 10, 11, None))


def test_nothing_to_learn_from(spark, edges, nothing):
    assert fit(nothing) is None
    assert {r.lang_pred for r in predict(edges, None).collect()} == {"und"}
    assert predict(nothing, None).collect() == []
    one = fit(edges)
    assert one.languages == ["en"]
    assert predict(nothing, one).collect() == []
    assert {r.lang_pred for r in predict(edges, one).collect()} == {"en", "und"}


def test_repeated_rows_are_learned_once(spark, monkeypatch):
    monkeypatch.setattr(languages, "FIT_ROWS", 40)
    rows = [(1, "aaa bbb", "x")] * 500 + [(i, f"ccc ddd {i}", "y") for i in range(2, 30)]
    found = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert found.languages == ["x", "y"]


def test_calibration():
    """Scores that are too sure come down to the share of right answers."""
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, 4000)
    right = rng.random(4000) < 0.8
    sure = np.where(right, labels, 1 - labels)
    logits = np.where(sure[:, None] == np.arange(2), 8.0, 0.0)
    made = Model(["a", "b"], np.zeros((1, 2)), np.zeros(2))
    calibrate(made, logits, labels)
    assert made.probabilities(logits).max(1).mean() == pytest.approx(0.8, abs=0.03)
    assert (made.probabilities(logits).max(1) < made.accepted_from).all()


def test_training_tells_two_alphabets_apart():
    rng = np.random.default_rng(2)
    examples = [rng.integers(0, 500, 60) + 1000 * (i // 2 % 2) for i in range(200)]
    labels = np.array([i // 2 % 2 for i in range(200)])
    made = train([e.astype(np.int32) for e in examples], labels, ["a", "b"])
    logits = np.array([made.table[e].mean(0) for e in examples])
    assert (made.probabilities(logits).argmax(1) == labels).all()
