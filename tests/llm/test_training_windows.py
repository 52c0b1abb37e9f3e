"""The language model is trained on every window."""

from __future__ import annotations

from tests.llm.conftest import frame
from trolley.llm import lm
from trolley.llm.queries import BYTE_PIECES


def test_every_window_is_a_sample(spark):
    docs = frame(spark, [(i, "the man and the dog went to the house") for i in range(50)])
    ranks = spark.sparkContext.broadcast(lm.read_ranks(BYTE_PIECES))
    samples = lm.gathered(docs, ranks).where(f"kind = {lm.SAMPLE}").collect()
    assert len({r.key for r in samples}) == len(samples) == 50
