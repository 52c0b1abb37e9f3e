"""Align the tokens of two vocabularies over a corpus, and count which ids go together.

A is a byte-level BPE over a space and the text, B a SentencePiece model over the text, which adds
that space itself, so both spell the same bytes. Byte offsets where a token of A and one of B
both end cut them into groups; within a group every token of A is linked to every one of B. The
count of a pair of ids is the number of documents that hold it linked.

Most groups are one token of each with the same bytes. An array from A's ids to B's of the same
bytes tells such pairs, which tasks count in vectors as long as A's vocabulary. Only other pairs
are shuffled: the distinct ones of a chunk of documents with their counts, and back to the chunk
what they add up to.

No token of A or B goes over a space that stands between two other characters, so the groups of a
text are those of the runs between such spaces, and every task keeps the runs it has seen.

Defined results: a null or empty text, and one that B does not spell byte by byte (it holds the
character U+2581), has no tokens, zeros and an empty digest. Special tokens written in a text are
plain text. Repeated rows each count as a document; a null doc_id is kept. Ties for an id's
highest count are all highest. An empty table gives an empty result. A long text is a chunk of its
own. Columns besides ``doc_id`` and ``text`` take no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.hashing import text_chunks
from trolley.llm.stages import staged

#: A chunk of documents ends with the text that brings it to so many bytes.
CHUNK = 1 << 21
#: Runs, and pairs of theirs, that a task remembers before it starts anew.
REMEMBERED, REMEMBERED_PAIRS = 250_000, 2_000_000
#: So many runs are handed to A's tokenizer as one text.
TOGETHER = 64
_AWKWARD = re.compile(r"\s | \s|\A | \Z")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ENCODED = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, "
    "at array<int>, times array<int>, pairs array<long>, pair_docs array<int>, vector array<long>"
)
_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
    "count_sum long, groups_sha256 string"
)


@dataclass(frozen=True)
class Tokenizers:
    """What tasks build both tokenizers from: A's JSON and B's model."""

    a: str
    b: bytes


def read_tokenizers(a_path: str, b_path: str) -> Tokenizers:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return Tokenizers(a.read(), b.read())


def _byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 characters are their bytes, others follow."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        from sentencepiece import SentencePieceProcessor

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizers.a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=tokenizers.b)
        byte, entries = _byte_of_character(), self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            a_bytes[i] = bytes(byte[c] for c in entry if c in byte)
        b_bytes = [self._surface(i) for i in range(self.b.vocab_size())]
        # A piece goes before a byte piece of the same bytes, and a smaller id before a larger.
        ids = sorted(range(len(b_bytes)), key=lambda i: (not self.b.is_byte(i), i), reverse=True)
        of = {b_bytes[i]: i for i in ids if b_bytes[i]}
        self.a_length = np.array([len(x) for x in a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in b_bytes], np.int64)
        self.size_a, self.size_b = len(a_bytes), len(b_bytes)
        self.same = np.array([of.get(x, -1) for x in a_bytes], np.int64)
        # Each id in decimal, with room for what comes after it.
        names = [str(i).encode() for i in range(max(self.size_a, self.size_b))]
        self.name_length = np.array([len(x) for x in names], np.int64)
        room = int(self.name_length.max()) + 1
        self.names = np.frombuffer(b"".join(x.ljust(room) for x in names), np.uint8).reshape(-1, room)

    def _surface(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
            return b""
        return piece.replace("▁", " ").encode()


@lru_cache(maxsize=2)
def _pair(tokenizers: Tokenizers) -> Pair:
    """One for each Python worker, which may run many tasks."""
    return Pair(tokenizers)


def runs(text: str) -> list[str]:
    """The parts of a space and ``text`` between which tokens end, without the space before each."""
    if _AWKWARD.search(text) is None:
        return text.split(" ")
    return [part[1:] for part in _CUT.split(f" {text}")]


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the list of each."""
    of = np.repeat(np.arange(len(ids)), np.fromiter(map(len, ids), np.int64, len(ids)))
    return np.fromiter(chain.from_iterable(ids), np.int64, len(of)), of


def encode_spaced(pair: Pair, spaced: list[str], wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A's ids of texts of ``wide`` bytes that start with a space, and the text of each.

    A token starts at a space between two other characters, so texts without further white space
    at their ends are encoded as one and told apart by their bytes. Others are encoded alone.
    """
    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in pair.a.encode_batch_fast(texts, add_special_tokens=False)]

    alone = np.fromiter((len(x) == 1 or x[1:] != x.strip() for x in spaced), bool, len(spaced))
    joined = np.flatnonzero(~alone)
    some = list(map(spaced.__getitem__, joined.tolist()))
    a, _ = _joined(encode(["".join(some[i : i + TOGETHER]) for i in range(0, len(some), TOGETHER)]))
    ends, cuts = np.cumsum(pair.a_length[a]), np.cumsum(wide[joined])
    if not (len(ends) and ends[-1] == cuts[-1] and np.isin(cuts, ends).all()):
        return _joined(encode(spaced))
    of = joined[np.searchsorted(cuts, ends)]
    if len(joined) == len(spaced):
        return a, of
    rest = np.flatnonzero(alone)
    others, others_of = _joined(encode(list(map(spaced.__getitem__, rest.tolist()))))
    of = np.concatenate([of, rest[others_of]])
    order = np.argsort(of, kind="stable")
    return np.concatenate([a, others])[order], of[order]


def spread(counts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The numbers from each first, as many as its count."""
    before = np.cumsum(counts) - counts
    return np.repeat(firsts - before, counts) + np.arange(counts.sum())


Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def _written(pair: Pair, a: Side, b: Side, tokens: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each run, of ``tokens`` tokens of A and B together.

    A side has the ids, the group of each, and the number of ids of each group.
    """
    (a, a_group, n_a), (b, b_group, n_b) = a, b
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + (ends_b - n_b)[a_group]] = a
    ids[np.arange(len(b)) + ends_a[b_group]] = b
    after[ends_a + ends_b - n_b - 1] = ord("|")
    after[ends_a + ends_b - 1] = ord(";")
    length = pair.name_length[ids]
    characters = pair.names[ids]
    characters[np.arange(len(ids)), length] = after
    whole = characters[np.arange(characters.shape[1]) <= length[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(length + 1)])[np.cumsum(tokens)]
    firsts = np.concatenate([[0], ends])[:-1]
    return [whole[x:y] for x, y in zip(firsts.tolist(), np.maximum(firsts, ends - 1).tolist())]


class Aligner:
    """Groups and pairs of runs; remembers those it has seen."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.pair = _pair(tokenizers)
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self.groups: list[bytes] = []
        # For each run: tokens of A, of B, groups, links, and whether B spells other bytes.
        self.sizes = np.zeros((0, 5), np.int64)
        self.first = np.zeros(1, np.int64)
        self.codes = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        pair = self.pair
        spaced = [f" {run}" for run in new]
        n = len(new)
        wide = np.fromiter((len(run.encode()) for run in spaced), np.int64, n)
        a, a_of = encode_spaced(pair, spaced, wide)
        b, b_of = _joined(pair.b.encode(new, num_threads=1))
        wide_b = np.bincount(b_of, pair.b_length[b], n).astype(np.int64)
        wide_a = np.bincount(a_of, pair.a_length[a], n).astype(np.int64)
        bad = (wide_a != wide) | (wide_b != wide)
        a, a_of = a[~bad[a_of]], a_of[~bad[a_of]]
        b, b_of = b[~bad[b_of]], b_of[~bad[b_of]]
        a_end, b_end = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
        ends_a, shared = np.zeros((2, int(wide.sum()) + 1), bool)
        ends_a[a_end] = shared[b_end] = True
        shared &= ends_a
        before = np.cumsum(shared) - shared
        a_group, b_group = before[a_end], before[b_end]
        n_groups = int(np.count_nonzero(shared))
        of = np.zeros(n_groups, np.int64)
        of[a_group] = a_of
        n_a, n_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        tokens = np.bincount(a_of, minlength=n) + np.bincount(b_of, minlength=n)
        self.groups.extend(_written(pair, (a, a_group, n_a), (b, b_group, n_b), tokens))
        # Distinct ids of a group with how often it has them, then all pairs of these.
        ua, ta = np.unique(a_group * pair.size_a + a, return_counts=True)
        ub, tb = np.unique(b_group * pair.size_b + b, return_counts=True)
        few_b = np.bincount(ub // pair.size_b, minlength=n_groups)
        first_b = np.cumsum(few_b) - few_b
        group = ua // pair.size_a
        partner = spread(few_b[group], first_b[group])
        left = np.repeat(np.arange(len(ua)), few_b[group])
        code = (ua[left] % pair.size_a) * pair.size_b + ub[partner] % pair.size_b
        span = pair.size_a * pair.size_b
        keys, inverse = np.unique(of[group[left]] * span + code, return_inverse=True)
        times = np.bincount(inverse, ta[left] * tb[partner], len(keys)).astype(np.int64)
        per_run = np.bincount(keys // span, minlength=n)
        sizes = np.stack(
            [
                np.bincount(a_of, minlength=n),
                np.bincount(b_of, minlength=n),
                np.bincount(of, minlength=n),
                np.bincount(of, n_a * n_b, n).astype(np.int64),
                bad,
            ],
            axis=1,
        )
        self._place.update(zip(new, range(len(self._place), len(self._place) + n)))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(per_run)])
        self.codes = np.concatenate([self.codes, keys % span])
        self.times = np.concatenate([self.times, times])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the runs of all ``texts``, and how many each has; unspelt texts have none."""
        if len(self._place) > REMEMBERED or len(self.codes) > REMEMBERED_PAIRS:
            self._forget()
        split = [runs(text) if text else [] for text in texts]
        known, flat = self._place, list(chain.from_iterable(split))
        new = [run for run in dict.fromkeys(flat) if run not in known]
        if new:
            self._learn(new)
        counts = np.array([len(parts) for parts in split], np.int64)
        place = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(texts)), counts)
        lost = np.zeros(len(texts), bool)
        lost[row[self.sizes[place, 4] > 0]] = True
        counts[lost] = 0
        return place[~lost[row]], counts

    def written(self, places: list[int]) -> bytes:
        return b";".join(map(self.groups.__getitem__, places))


def _within(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each stretch of ``counts`` values."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _lists(firsts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(values, kind))


def _record(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of the encoded table; columns that are not given are null."""
    schema = pa.schema(
        [
            *[(n, pa.int64()) for n in ("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links")],
            ("digest", pa.string()),
            *[(n, pa.list_(pa.int32())) for n in ("at", "times")],
            ("pairs", pa.list_(pa.int64())),
            ("pair_docs", pa.list_(pa.int32())),
            ("vector", pa.list_(pa.int64())),
        ]
    )
    arrays = [columns.get(f.name, pa.nulls(rows, f.type)) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _chunk(
    aligner: Aligner, chunk: int, ids: pa.Array, texts: list[str | None], vector: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk and its irregular pairs; the others are added to ``vector``."""
    pair, n = aligner.pair, len(texts)
    place, counts = aligner(texts)
    sizes = _within(counts, aligner.sizes[place])
    bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
    listed = place.tolist()
    digests = [
        hashlib.sha256(aligner.written(listed[x:y])).hexdigest() if y > x else ""
        for x, y in zip(bounds, bounds[1:])
    ]
    # Distinct runs of each document, then its distinct pairs with how often it links them.
    known = len(aligner.sizes)
    held, often = np.unique(np.repeat(np.arange(n), counts) * known + place, return_counts=True)
    doc, run = held // known, held % known
    width = aligner.first[run + 1] - aligner.first[run]
    entry = spread(width, aligner.first[run])
    span = pair.size_a * pair.size_b
    keys, inverse = np.unique(
        np.repeat(doc, width) * span + aligner.codes[entry], return_inverse=True
    )
    times = np.bincount(inverse, aligner.times[entry] * np.repeat(often, width), len(keys))
    doc, code = keys // span, keys % span
    left = code // pair.size_b
    regular = pair.same[left] == code % pair.size_b
    vector += np.bincount(left[regular], minlength=pair.size_a)
    pairs, spot, pair_docs = np.unique(code[~regular], return_inverse=True, return_counts=True)
    at = left.copy()
    at[~regular] = pair.size_a + spot
    firsts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    yield _record(
        n,
        chunk=pa.array(np.full(n, chunk)),
        doc_id=ids,
        **{name: pa.array(sizes[:, i]) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        digest=pa.array(digests, pa.string()),
        at=_lists(firsts, at, pa.int32()),
        times=_lists(firsts, times.astype(np.int64), pa.int32()),
    )
    if len(pairs):
        ends = np.array([0, len(pairs)])
        yield _record(
            1,
            chunk=pa.array([chunk]),
            pairs=_lists(ends, pairs, pa.int64()),
            pair_docs=_lists(ends, pair_docs, pa.int32()),
        )


@dataclass
class Alignment:
    """The written tokens of a corpus, and what its pairs add up to.

    ``regular`` has the number of documents of each identity pair by A's id, and ``top`` the
    highest count of each A id; both are as long as A's vocabulary. ``irregular`` has code and
    documents of the other pairs.
    """

    encoded: DataFrame
    irregular: DataFrame
    regular: np.ndarray
    top: np.ndarray
    same: np.ndarray
    size_b: int


def align(docs: DataFrame, tokenizers: Tokenizers) -> Alignment:
    held = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(held.value)
        vector = np.zeros(aligner.pair.size_a, np.int64)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last, _, _ in text_chunks(batch.column(1), CHUNK):
                part = batch.slice(first, last - first)
                yield from _chunk(aligner, chunk, part.column(0), part.column(1).to_pylist(), vector)
                chunk += 1
        if vector.any():
            yield _record(1, vector=_lists(np.array([0, len(vector)]), vector, pa.int64()))

    texts = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")
    )
    encoded = staged(texts.mapInArrow(run, _ENCODED), "encoded")
    pair = _pair(tokenizers)
    regular = _by_id(
        encoded.where("vector is not null").select(F.posexplode("vector").alias("id", "n")),
        F.sum("n"),
        pair.size_a,
    )
    irregular = staged(
        encoded.where("pairs is not null")
        .select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("pair"))
        .groupBy(F.col("pair.pairs").alias("code"))
        .agg(F.sum("pair.pair_docs").alias("docs")),
        "pairs",
    )
    irregular_top = _by_id(
        irregular.select((F.col("code") / pair.size_b).cast("int").alias("id"), F.col("docs").alias("n")),
        F.max("n"),
        pair.size_a,
    )
    return Alignment(
        encoded, irregular, regular, np.maximum(regular, irregular_top), pair.same, pair.size_b
    )


def _by_id(rows: DataFrame, total, size: int) -> np.ndarray:
    """One number for each id of A: no more rows reach the driver than A has ids."""
    found = rows.where("n > 0").groupBy("id").agg(total.alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def pair_counts(aligned: Alignment) -> DataFrame:
    """a_id, b_id, documents and whether no pair of that A id has more, of all linked pairs."""
    spark = aligned.encoded.sparkSession
    ids = np.flatnonzero(aligned.regular)
    regular = spark.createDataFrame(
        pa.table({"a_id": ids, "b_id": aligned.same[ids], "documents": aligned.regular[ids]})
    )
    top = spark.createDataFrame(
        pa.table({"a_id": np.arange(len(aligned.top)), "_top": aligned.top})
    )
    code = F.col("code")
    return (
        aligned.irregular.select(
            F.floor(code / aligned.size_b).alias("a_id"),
            (code % aligned.size_b).alias("b_id"),
            F.col("docs").alias("documents"),
        )
        .unionByName(regular)
        .join(F.broadcast(top), "a_id")
        .select("a_id", "b_id", "documents", (F.col("documents") == F.col("_top")).alias("best"))
    )


def aligned_documents(aligned: Alignment) -> DataFrame:
    """Tokens, groups, links, links of the highest count, sum of counts and digest of each row."""
    encoded = aligned.encoded
    looked_up = (
        encoded.where("pairs is not null")
        .select("chunk", F.posexplode("pairs").alias("spot", "code"))
        .join(aligned.irregular, "code")
        .select(F.col("chunk").alias("in_chunk"), "spot", "code", "docs")
    )
    held = encoded.sparkSession.sparkContext.broadcast(
        (aligned.regular, aligned.top, aligned.size_b)
    )

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        regular, top, size_b = held.value
        spot = found["spot"].to_numpy()
        n, best = np.zeros(len(regular) + len(spot), np.int64), np.zeros(len(regular) + len(spot), bool)
        n[: len(regular)], best[: len(regular)] = regular, regular == top
        docs_of = found["docs"].to_numpy()
        n[len(regular) + spot] = docs_of
        best[len(regular) + spot] = docs_of == top[found["code"].to_numpy() // size_b]
        at = docs["at"].combine_chunks()
        width = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = at.flatten().to_numpy(zero_copy_only=False)
        times = docs["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.table(
            {
                **{c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                "n_best": _within(width, times * best[place]),
                "count_sum": _within(width, times * n[place]),
                "groups_sha256": docs["digest"],
            }
        )

    rows = encoded.where("digest is not null").drop("pairs", "pair_docs", "vector")
    return (
        rows.groupBy("chunk").cogroup(looked_up.groupBy("in_chunk")).applyInArrow(score, _RESULT)
    )


def token_groups(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """doc_id and the groups of each row as text: ``a1,a2|b1;a3|b2,b3``."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(held.value)
        for batch in batches:
            for first, last, _, _ in text_chunks(batch.column(1)):
                part = batch.slice(first, last - first)
                place, counts = aligner(part.column(1).to_pylist())
                listed, ends = place.tolist(), np.cumsum(counts).tolist()
                written = [
                    aligner.written(listed[y - x : y]).decode()
                    for x, y in zip(counts.tolist(), ends)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(written, pa.string())], ["doc_id", "groups"]
                )

    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, groups string")
