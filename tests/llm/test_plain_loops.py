"""Scores of the quality classifier and of the language model, rebuilt by plain loops."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
import tiktoken

from tests.llm.conftest import frame
from trolley.llm import attention, lm, quality
from trolley.llm.hashing import WordHasher, mixed
from trolley.llm.queries import BYTE_PIECES

TEXTS = [
    "the cat sat on the mat and the dog sat on the cat",
    "The DOG, the dog! über naïve 日本",
    "",
    "one",
    " ".join(f"word{i % 9} the" for i in range(60)),
]


def words_of(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    for gap in (b"\t", b"\n", b"\v", b"\f", b"\r"):
        raw = raw.replace(gap, b" ")
    return [word for word in raw.split(b" ") if word]


def test_quality_by_plain_loops(spark, monkeypatch):
    """Evidence from the weights of a text's words and last bytes; quality from it and the prior."""
    rng = np.random.default_rng(1)
    weights = rng.normal(size=quality.BUCKETS).astype(np.float32)
    monkeypatch.setattr(quality, "fit_on", lambda docs, labels: (weights, 0.25))
    rows = [(i, text, f"s{i % 2}") for i, text in enumerate(TEXTS * 2)]
    labels = spark.createDataFrame([(i, i % 3 != 0) for i in range(8)], "doc_id LONG, good BOOLEAN")
    labels = labels.selectExpr("doc_id", "cast(good as int) as quality")
    found = {r.doc_id: r for r in quality.judge(frame(spark, rows), labels).collect()}
    hasher = WordHasher()
    for i, text, _ in rows:
        buckets = set()
        for word in words_of(text):
            data = np.frombuffer(word, np.uint8)
            buckets.add(int(hasher(data, np.array([0]), np.array([len(data)]))[0]) % quality.BUCKETS)
            last = mixed(np.array([word[-1] + (1 << 40)], np.uint64))
            buckets.add(int(last[0]) % quality.BUCKETS)
        evidence = 0.0
        if buckets:
            evidence = sum(float(weights[b]) for b in buckets) / math.sqrt(len(buckets)) + 0.25
        r = found[i]
        assert r.evidence == pytest.approx(evidence, abs=1e-4)
        odds = evidence + math.log(r.prior / (1 - r.prior))
        assert r.quality == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-5)
        assert r.keep == (r.quality >= 0.5)


def plain_log(logits):
    top = max(logits)
    total = top + math.log(sum(math.exp(x - top) for x in logits))
    return [x - total for x in logits]


def plain_token_logs(weights, known, before, ids):
    """The natural log of each id's probability, one window, place and pair after another."""
    w = {name: value.astype(float) for name, value in weights.items()}
    out, start = [None] * len(ids), 0
    while True:
        window = range(start, min(start + attention.WINDOW, len(ids)))
        x = [w["embed"][known.input_of[before[i]]] + w["place"][i - start] for i in window]
        qkv = [row @ w["qkv"] for row in x]
        for place, i in enumerate(window):
            if out[i] is not None:
                continue
            q = qkv[place][: attention.WIDTH]
            share = []
            for j in range(place + 1):
                k = qkv[j][attention.WIDTH : 2 * attention.WIDTH]
                share.append(math.exp(q @ k / math.sqrt(attention.WIDTH) + w["apart"][place - j]))
            read = sum(s * qkv[j][2 * attention.WIDTH :] for j, s in enumerate(share)) / sum(share)
            hidden = np.maximum(np.concatenate([x[place], read]) @ w["mix"] + w["bias"], 0)
            logits = hidden @ w["out"] + known.prior[before[i]]
            of_class = plain_log(logits.tolist())[known.class_of[ids[i]]]
            within = known.inside(np.array([before[i]]), np.array([ids[i]]))[0]
            out[i] = of_class + float(within)
        if start + attention.WINDOW >= len(ids):
            return out
        start += attention.STRIDE


def test_language_model_by_plain_loops(spark, monkeypatch):
    kept = {}

    def remembering(name):
        function = getattr(lm, name)

        def run(*args):
            kept[name] = function(*args)
            return kept[name]

        monkeypatch.setattr(lm, name, run)

    remembering("trained")
    remembering("known_counts")
    rows = [(i, text) for i, text in enumerate(TEXTS * 6)]
    ranks = lm.read_ranks(BYTE_PIECES)
    docs = frame(spark, rows)
    found = {r.doc_id: r for r in lm.score(docs, ranks).collect()}
    weights, known = attention.unflat(kept["trained"]), kept["known_counts"]
    assert np.abs(weights["out"]).max() > 0
    held = {r.doc_id for r in docs.where(lm.held_out()).select("doc_id").collect()}
    counts = Counter()
    for i, text in rows:
        if i not in held:
            counts.update([*words_of(text), b""])
    total, end = sum(counts.values()), max(ranks.values()) + 1
    encoder = tiktoken.Encoding("w", pat_str=r"[\s\S]{1,64}", mergeable_ranks=ranks, special_tokens={})
    for i, text in rows[: len(TEXTS)]:
        parts = [encoder.encode_ordinary(" " + word.decode()) for word in words_of(text)] + [[end]]
        ids = [x for part in parts for x in part]
        logs = plain_token_logs(weights, known, [end, *ids[:-1]], ids)
        score, at = 0.0, 0
        for word, part in zip([*words_of(text), b""], parts):
            spelt = math.log(1 - lm.WHOLE) + sum(logs[at : at + len(part)])
            at += len(part)
            choices = [spelt]
            if counts[word]:
                choices.append(math.log(lm.WHOLE * counts[word] / total))
            top = max(choices)
            score += top + math.log(sum(math.exp(c - top) for c in choices))
        assert found[i].score == pytest.approx(score / math.log(10), abs=2e-3)
