"""Alignment of two tokenizers against plain loops over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES, frame
from trolley.llm import alignment
from trolley.llm.alignment import aligned_documents, align, pair_counts, read_tokenizers, token_groups
from trolley.llm.queries import BYTE_BPE, PIECES, op11_token_alignment

SMALL = "/root/testdata/sf0.001"
AWKWARD = [
    " leads",
    "trails ",
    "two  spaces   three",
    "   ",
    " ",
    "\n",
    "a\n\n b \n c\r\n\r\nd\t\te",
    "has ▁ mark",
    "no▁",
    "thin space nbsp x   y　z \x1c! \x85 \x0b",
    "<|endoftext|> and </s><s> <0x41> <unk>",
    "it's we'll I'D don't 'tis ' s",
    "123,456.78 3½ ﬁ é é",
    "\U0001f642\U0001f469‍\U0001f4bb 日本語 ال हि",
    "nul\x00nul \x7f",
    "x" * 5000,
    "᠎ y ﻿",
    "the the the cat",
    "the cat",
]


def brute_force(texts):
    """For each text its numbers and digest, by loops over tokens of the whole text."""
    a_model = Tokenizer.from_file(BYTE_BPE)
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=PIECES)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte, extra = {chr(b): b for b in visible}, 256
    for b in range(256):
        if b not in visible:
            byte[chr(extra)] = b
            extra += 1
    found = []
    for text in texts:
        a, b = [], []
        if text:
            for i in a_model.encode(f" {text}", add_special_tokens=False).ids:
                a.append((i, bytes(byte[c] for c in a_model.id_to_token(i))))
            for i in b_model.encode(text):
                piece = b_model.id_to_piece(i)
                b.append(
                    (i, bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode())
                )
            whole = f" {text}".encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        ends = []
        for tokens in (a, b):
            at, out = 0, []
            for i, piece in tokens:
                at += len(piece)
                out.append((i, at))
            ends.append(out)
        shared = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        groups, before = [], 0
        for end in shared:
            groups.append(
                tuple([i for i, e in side if before < e <= end] for side in ends)
            )
            before = end
        found.append(groups)
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for groups in found]
    docs = Counter(pair for linked in links for pair in linked)
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    rows = []
    for groups, linked in zip(found, links):
        written = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        rows.append(
            (
                sum(len(g[0]) for g in groups),
                sum(len(g[1]) for g in groups),
                len(groups),
                sum(linked.values()),
                sum(t for pair, t in linked.items() if docs[pair] == top[pair[0]]),
                sum(t * docs[pair] for pair, t in linked.items()),
                hashlib.sha256(written.encode()).hexdigest() if groups else "",
            )
        )
    return rows, docs, top


def rows_of(df):
    return sorted(
        (tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:])
    )


@pytest.fixture(scope="module")
def tokenizers():
    return read_tokenizers(BYTE_BPE, PIECES)


@pytest.mark.parametrize("chunk", [1 << 21, 40])
def test_awkward_texts(spark, tokenizers, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    texts = [(100 + i, text) for i, text in enumerate(AWKWARD)]
    given = [(i, t) for i, t in EDGES if not t or len(t) < 100_000] + texts
    expected, docs, top = brute_force([t for _, t in given])
    aligned = align(frame(spark, given).repartition(3), tokenizers)
    assert rows_of(aligned_documents(aligned)) == sorted(
        ((i, *row) for (i, _), row in zip(given, expected)),
        key=lambda r: (r[0] is None, r[0] or 0, r[1:]),
    )
    counted = {(r.a_id, r.b_id): (r.documents, r.best) for r in pair_counts(aligned).collect()}
    assert counted == {pair: (n, n == top[pair[0]]) for pair, n in docs.items()}


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected, _, _ = brute_force([r.text for r in docs])
    found = op11_token_alignment(spark, SMALL)
    assert rows_of(found) == sorted((r.doc_id, *row) for r, row in zip(docs, expected))


def test_groups_have_the_digest(spark, edges, tokenizers):
    groups = token_groups(edges, tokenizers).collect()
    digests = aligned_documents(align(edges, tokenizers)).collect()
    written = Counter(
        (r.doc_id, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in groups
    )
    assert written == Counter((r.doc_id, r.groups_sha256) for r in digests)


def test_empty_table(spark, nothing, tokenizers):
    aligned = align(nothing, tokenizers)
    assert aligned_documents(aligned).collect() == [] and pair_counts(aligned).collect() == []
    assert token_groups(nothing, tokenizers).collect() == []


def test_runs_encoded_as_one_text_have_the_tokens_of_each(tokenizers):
    pair = alignment.Pair(tokenizers)
    runs = ["one", "two.", "a\nb", "é日本", "🙂", "", " x", "x ", "\t", "x ", "it's", "9" * 70, "<|endoftext|>"] * 9
    spaced = [f" {run}" for run in runs]
    called = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            called.append(len(texts))
            return plain.encode_batch_fast(texts, **options)

    plain, pair.a = pair.a, Counting()
    wide = np.array([len(text.encode()) for text in spaced])
    ids, of = alignment.encode_spaced(pair, spaced, wide)
    each = [plain.encode(text, add_special_tokens=False).ids for text in spaced]
    assert [ids[of == i].tolist() for i in range(len(runs))] == each
    alone = sum(run != run.strip() or not run for run in runs)
    assert sum(called) == alone + -(-(len(runs) - alone) // alignment.TOGETHER)
    ids, of = alignment.encode_spaced(pair, [" ", "  "], np.array([1, 2]))
    assert [ids[of == i].tolist() for i in (0, 1)] == [
        plain.encode(text, add_special_tokens=False).ids for text in (" ", "  ")
    ]
