"""Windows reach the trainers packed, dealt out once for all rounds."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from trolley.llm import attention, lm
from trolley.llm.queries import BYTE_PIECES


def texts(n):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 5))) for _ in range(300)]
    return [(i, " ".join(rng.choice(words, rng.integers(0, 150)))) for i in range(n)]


def test_windows_take_little_disk(spark, monkeypatch):
    kept = {}

    def staged(df, name, function=lm.staged):
        kept[name] = function(df, name)
        return kept[name]

    monkeypatch.setattr(lm, "staged", staged)
    docs = frame(spark, texts(600))
    ranks = lm.read_ranks(BYTE_PIECES)
    samples = lm.gathered(docs.where(~lm.held_out()), spark.sparkContext.broadcast(ranks))
    windows = samples.where(F.col("kind") == lm.SAMPLE).count()
    assert lm.score(docs, ranks).count() == 600
    of_windows = [kept["windows"], kept["gathered"]]
    size = sum(
        os.path.getsize(unquote(urlparse(file).path)) for df in of_windows for file in df.inputFiles()
    )
    counts = kept["gathered"].where(F.col("kind") != lm.SAMPLE).count()
    assert size < 50 * windows + 16 * counts + 20_000
    assert kept["windows"].agg(F.sum("n")).first()[0] == windows


def test_packs_hold_what_a_shuffle_by_key_deals_out(spark):
    of_id = np.uint16
    ranks = spark.sparkContext.broadcast(lm.read_ranks(BYTE_PIECES))
    docs = frame(spark, texts(120)).repartition(5)
    samples = lm.gathered(docs, ranks, count=False).select("key", "ids")
    dealt = samples.repartition(7, "key").select(F.spark_partition_id().alias("part"), "key", "ids")
    parts = {}
    for row in sorted(dealt.collect()):
        parts.setdefault(row.part, []).append(np.frombuffer(row.ids, of_id))
    expected = sorted(np.stack(rows).tolist() for rows in parts.values())
    found = [
        lm._unsqueezed(row.ids, row.n, of_id).tolist()
        for row in lm.packed(samples, 7, of_id).collect()
    ]
    assert sorted(found) == expected and len(found) == 7


def test_ids_beyond_two_bytes_are_kept():
    assert lm.id_type(50_257) is np.uint16 and lm.id_type(2**16 - 2) is np.uint16
    assert lm.id_type(2**16 - 1) is np.int32
    held = np.arange(2 * (attention.WINDOW + 1), dtype=np.int32).reshape(2, -1) * 70_000
    assert (lm._unsqueezed(lm._squeezed(held), 2, np.int32) == held).all()
