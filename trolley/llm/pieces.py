"""Encode and decode texts with SentencePiece pieces.

Encoding takes the segmentation with the highest sum of log scores (Viterbi over a unigram
model). All pieces that start at a byte come from a walk through a double-array trie, for all
bytes of a batch at once. A character without a piece becomes its bytes where the vocabulary
has byte pieces, and otherwise the unknown piece. Spaces become the marker U+2581, one goes
before the text, and decoding turns them back.

No piece holds a marker after another character, so the best segmentation of a text consists of
those of its words, each with the markers before it; every task keeps those it has seen.

A vocabulary whose scores are merge ranks (of a BPE model) has no log scores. It gets those of
Zipf's law by its ranks: the log of ``1 / (rank + 1)``, divided by the sum of these.

Defined results: a null text has null ids and decodes to null, an empty one has none. A marker
character in a text decodes to a space, as in SentencePiece. Bytes that are no UTF-8 decode to
replacement characters. Of equal sums the one whose last piece is longest is taken. Repeated
rows each get their ids; an empty table gives an empty result. Columns besides ``doc_id`` and
``text`` take no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trolley.llm.hashing import text_chunks

MARK = "▁"
UNKNOWN = " ⁇ "
#: A character without a piece scores so much less than the worst piece.
PENALTY = 10.0
#: Words that a task remembers before it starts anew.
REMEMBERED = 150_000
#: Words of up to so many bytes are segmented together, longer ones apart.
SHORT = 64
TEXTS = 512
#: Texts are encoded in parts of about so many bytes.
PART = 1 << 20
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Trie:
    """A double-array trie over bytes: state ``s`` goes by byte ``c`` to ``base[s] + c``.

    A base may be negative. Then a byte without a child can lead to the last 256 places, which
    belong to no state.
    """

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(keys: list[bytes]) -> Trie:
    """The trie of ``keys``; a key's value is its place in the list."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    size = 1024 + 16 * len(keys)
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    free, loose, nodes = 1, 1, [(0, 0, len(order), 0)]
    for state, low, high, depth in nodes:
        while low < high and len(keys[order[low]]) == depth:
            value[state] = order[low]
            low += 1
        children = []
        while low < high:
            byte, first = keys[order[low]][depth], low
            while low < high and keys[order[low]][depth] == byte:
                low += 1
            children.append((byte, first, low))
        if not children:
            continue
        while check[free] >= 0:
            free += 1
        loose = max(loose, free)
        # One child fits any gap; several are tried from where gaps are not yet rare.
        at, tried = (free if len(children) == 1 else loose) - children[0][0], 0
        while True:
            if at + 512 > len(check):
                for array, fill in ((base, 0), (check, -1), (value, -1)):
                    array.extend([fill] * len(array))
            if all(check[at + byte] < 0 for byte, *_ in children):
                break
            at, tried = at + 1, tried + 1
        if tried > 32:
            loose = at + children[0][0]
        base[state] = at
        for byte, first, last in children:
            check[at + byte] = state
            nodes.append((at + byte, first, last, depth + 1))
    used = max(i for i, s in enumerate(check) if s >= 0) + 257
    base, check, value = (
        np.array(array[:used] + [fill] * max(0, used - len(array)), np.int32)
        for array, fill in ((base, 0), (check, -1), (value, -1))
    )
    return Trie(base, check, value)


class Vocabulary:
    """Pieces with log scores.

    ``kinds`` has ``normal``, ``unknown``, ``control`` or ``byte`` for each piece.
    """

    def __init__(
        self, pieces: list[str], scores: list[float], kinds: list[str], prefix: bool = True
    ) -> None:
        self.pieces, self.kinds, self.prefix = pieces, kinds, prefix
        self.scores = np.array(scores, np.float64)
        self.ids = np.array([i for i, k in enumerate(kinds) if k == "normal"], np.int32)
        normal = [pieces[i] for i in self.ids.tolist()]
        if any(MARK in piece.lstrip(MARK) for piece in normal):
            raise ValueError("a piece holds a space after another character")
        self.trie = build_trie([piece.encode() for piece in normal])
        unknown = [i for i, k in enumerate(kinds) if k == "unknown"]
        self.unknown = unknown[0] if unknown else -1
        self.bytes = np.full(256, self.unknown, np.int32)
        for i, kind in enumerate(kinds):
            if kind == "byte":
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.falls_back = "byte" in kinds
        least = self.scores[self.ids].min() if len(self.ids) else 0.0
        self.unknown_score = float(least) - PENALTY
        written = [self._surface(i) for i in range(len(pieces))]
        self.lengths = np.array([len(w) for w in written], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.written = np.frombuffer(b"".join(written), np.uint8)

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == "normal":
            return self.pieces[i].replace(MARK, " ").encode()
        if self.kinds[i] == "byte":
            return bytes([int(self.pieces[i][3:5], 16)])
        return UNKNOWN.encode() if self.kinds[i] == "unknown" else b""


def read_vocabulary(path: str, ranked: bool = False, prefix: bool = True) -> Vocabulary:
    """The pieces of a SentencePiece model; ``ranked`` if its scores are merge ranks."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    kinds = [
        "unknown"
        if model.is_unknown(i)
        else "byte"
        if model.is_byte(i)
        else "control"
        if model.is_control(i) or model.is_unused(i)
        else "normal"
        for i in ids
    ]
    scores = [model.get_score(i) for i in ids]
    if ranked:
        total = math.log(sum(1 / (1 - s) for s, k in zip(scores, kinds) if k == "normal"))
        scores = [
            -math.log1p(-s) - total if k == "normal" else 0.0 for s, k in zip(scores, kinds)
        ]
    return Vocabulary([model.id_to_piece(i) for i in ids], scores, kinds, prefix)


def segment(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all ``words`` one after another, the number of ids and the score of each."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = np.frombuffer(b"".join(words), np.uint8)
    of = np.repeat(np.arange(len(words)), lengths)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    trie = vocabulary.trie
    live, state, begins, finishes, keys = heads, np.zeros(len(heads), np.int64), [], [], []
    step = 0
    single = np.zeros(len(data) + 1, bool)
    after = np.append(heads[1:], len(data))
    char_end = np.zeros(len(data) + 1, np.int64)
    char_end[heads] = after
    while len(live):
        onward = trie.base[state] + data[live + step]
        good = trie.check[onward] == state
        live, state = live[good], onward[good]
        step += 1
        value = trie.value[state]
        hit = value >= 0
        begins.append(live[hit])
        finishes.append(live[hit] + step)
        keys.append(vocabulary.ids[value[hit]])
        single[live[hit][live[hit] + step == char_end[live[hit]]]] = True
        inside = live + step < ends[of[live]]
        live, state = live[inside], state[inside]
    alone = heads[~single[heads]]
    begin = np.concatenate([*begins, alone])
    finish = np.concatenate([*finishes, char_end[alone]])
    key = np.concatenate([*keys, np.full(len(alone), -1, np.int32)])
    score = np.where(key >= 0, vocabulary.scores[key], vocabulary.unknown_score)
    best = np.full(len(data) + len(words) + 1, -np.inf)
    back = np.full(len(best), -1, np.int64)
    own = of[begin]
    begin, finish = begin + own, finish + own
    best[starts + np.arange(len(words))] = 0.0
    reach = finish - own - starts[own]
    order = np.lexsort((finish - begin, reach))
    for some in np.split(order, np.flatnonzero(np.diff(reach[order])) + 1):
        value = best[begin[some]] + score[some]
        np.maximum.at(best, finish[some], value)
        top = value == best[finish[some]]
        back[finish[some][top]] = some[top]
    at = ends + np.arange(len(words))
    total = best[at]
    stop = starts + np.arange(len(words))
    who, picked, open_ = np.arange(len(words)), [], lengths > 0
    at, who = at[open_], who[open_]
    while len(at):
        edge = back[at]
        picked.append((who, edge))
        at = begin[edge]
        onward = at > stop[who]
        at, who = at[onward], who[onward]
    if not picked:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64), total
    step_of = np.repeat(np.arange(len(picked)), [len(p[0]) for p in picked])
    who, edge = (np.concatenate(parts) for parts in zip(*picked, strict=True))
    order = np.lexsort((-step_of, who))
    who, edge = who[order], edge[order]
    token, width = key[edge], np.ones(len(edge), np.int64)
    if vocabulary.falls_back:
        width = np.where(token < 0, finish[edge] - begin[edge], 1)
    first = np.cumsum(width) - width
    ids = np.repeat(token, width)
    lost = np.flatnonzero(ids < 0)
    if vocabulary.falls_back:
        place = np.repeat(begin[edge] - own[edge] - first, width)[lost] + lost
        ids[lost] = vocabulary.bytes[data[place]]
    else:
        ids[lost] = vocabulary.unknown
    return ids, np.bincount(who, width, len(words)).astype(np.int64), total


class Encoder:
    """Encodes lists of texts and remembers the words it has seen."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._ids = np.zeros(0, np.int32)
        self._first = np.zeros(1, np.int64)
        self._score = np.zeros(0)

    def _words(self, text: str) -> list[str]:
        """The words of ``text``, which start with a marker but for the first, if at all."""
        runs = text.startswith(" ") or "  " in text or MARK in text
        if self.vocabulary.prefix and not runs:
            return (MARK + text.replace(" ", f" {MARK}")).split(" ") if text else []
        marked = text.replace(" ", MARK)
        return _WORDS.findall(MARK + marked if self.vocabulary.prefix and text else marked)

    def _learn(self, words: list[str]) -> None:
        for few in (
            [w for w in words if len(w) <= SHORT],
            [w for w in words if len(w) > SHORT],
        ):
            if few:
                ids, counts, scores = segment(self.vocabulary, [w.encode() for w in few])
                for word in few:
                    self._place[word] = len(self._place)
                self._ids = np.concatenate([self._ids, ids])
                self._first = np.concatenate([self._first, self._first[-1] + np.cumsum(counts)])
                self._score = np.concatenate([self._score, scores])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after another, the number of ids and the score of each."""
        if len(self._place) > REMEMBERED:
            self._forget()
        split = [self._words(text) for text in texts]
        known = self._place
        self._learn(list(dict.fromkeys(w for words in split for w in words if w not in known)))
        at = np.fromiter((known[w] for words in split for w in words), np.int64)
        counts = self._first[at + 1] - self._first[at]
        firsts = np.cumsum(counts) - counts
        ids = self._ids[np.repeat(self._first[at] - firsts, counts) + np.arange(counts.sum())]
        bounds = np.concatenate([[0], np.cumsum([len(words) for words in split], dtype=np.int64)])
        sums = np.concatenate([[0], np.cumsum(counts)])[bounds]
        scores = np.concatenate([[0.0], np.cumsum(self._score[at])])[bounds]
        return ids, np.diff(sums), np.diff(scores)


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of ids that lie one after another, ``counts`` for each text."""
    lengths = vocabulary.lengths[ids]
    firsts = np.cumsum(lengths) - lengths
    written = vocabulary.written[
        np.repeat(vocabulary.starts[ids] - firsts, lengths) + np.arange(lengths.sum())
    ].tobytes()
    bounds = np.concatenate([[0], np.cumsum(lengths)])[
        np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    ].tolist()
    texts = [written[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
    if vocabulary.prefix:
        texts = [text.removeprefix(" ") for text in texts]
    return texts


def _encoded(encoder: Encoder, part: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """doc_id, ids and score of a few rows, and the ids once more with the number of each text."""
    texts = part.column(1).to_pylist()
    ids, counts, scores = encoder([text or "" for text in texts])
    missing = np.array([text is None for text in texts])
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array(missing))
    batch = pa.RecordBatch.from_arrays(
        [part.column(0), lists, pa.array(scores, mask=missing)], ["doc_id", "ids", "score"]
    )
    return batch, ids, counts


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded bytes, but for single texts that are longer."""
    for first, last, _, _ in text_chunks(batch.column(1), PART):
        yield batch.slice(first, last - first)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids and score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch in batches:
            for part in _parts(batch):
                yield _encoded(encoder, part)[0]

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, score double"
    )


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """As :func:`encode` and :func:`decode`, in one Python worker and with one vocabulary a task."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch in batches:
            for part in _parts(batch):
                encoded, ids, counts = _encoded(encoder, part)
                missing = encoded.column(1).is_null().to_numpy(zero_copy_only=False)
                texts = pa.array(decode_ids(held.value, ids, counts), pa.string(), mask=missing)
                yield pa.RecordBatch.from_arrays(
                    [*encoded.columns, texts], ["doc_id", "ids", "score", "text"]
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, score double, text string"
    )


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The columns of ``encoded``, doc_id, ids and score, with the decoded text."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                lists = part.column(1)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                texts = pa.array(
                    decode_ids(held.value, ids, counts), mask=lists.is_null().to_numpy(False)
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, texts.cast(pa.string())], ["doc_id", "ids", "score", "text"]
                )

    return encoded.select("doc_id", "ids", "score").mapInArrow(
        run, "doc_id long, ids array<int>, score double, text string"
    )
