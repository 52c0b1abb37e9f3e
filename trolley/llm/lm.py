"""Score texts with a causal self-attention model over subword ids, trained on the corpus.

One pass over the training documents counts words, pairs of subword ids and windows. The counts
give the model its prior (see ``attention``). Another pass cuts the texts into windows and deals
them out to the trainers, packed, once for all rounds. Each trainer makes a pass over its part of all windows, starting from
common weights; the mean of the trainers' weights is where the next round starts. Both the counts
and the windows grow with the corpus. A last pass scores all documents: windows overlap, every id
is scored once, and a batch of windows is one masked attention.

Texts are sequences of words, with ASCII letters in lower case, and an end. The subword ids of a
word are those of a byte-level vocabulary for the word after a space, so a sequence of words has
one sequence of ids. The attention model gives the probability of a word's ids and of the end;
it is mixed with the share that the word has of all frequent words.

The base score comes from word counts. Words with a share of ``FREQUENT`` or more of all tokens,
two million at most, are counted where the text is read; other words are joined with their counts.
Words are told apart by 64-bit hashes.

Defined results: a null text is empty and has the end as its only token. A null id counts as an
empty one, whose checksum is 0, so it is held out. Without training documents every probability
is smoothing. Repeated rows each get their score and each train. An empty table gives an empty
result. Columns besides ``doc_id`` and ``text`` take no part.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm import attention
from trolley.llm.attention import CLASSES, FLOAT, PAIRED, WINDOW, Counted
from trolley.llm.hashing import LOWER, WordHasher, hash_long, mixed, text_chunks, word_bounds
from trolley.llm.stages import buckets_for, staged

FREQUENT = 5e-7
#: Every window is trained on; so many make a trainer's part.
PART = 1 << 15
RATES = (1e-2, 3e-3)
#: The weight of whole words: a frequent word is drawn by its count this often, else spelt by the
#: attention model.
WHOLE = 0.3
#: The end of a text among the hashes of words.
END_WORD = 0
#: Words that a Python worker remembers, and distinct counts that a task holds before it passes
#: them on.
REMEMBERED = 400_000
HELD = 1_500_000
#: Windows that a task packs at a time, into a row for each trainer.
PACKED = 1 << 18
_SUBWORDS: list[Subwords] = []


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level vocabulary: lines of a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10 == 0


class Subwords:
    """Ids of the words of a chunk; remembers those of the words it has seen.

    ``counted`` has the distinct hashes of the last chunk and how often each occurs.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.ranks, self.end = ranks, max(ranks.values()) + 1
        self._encoder = tiktoken.Encoding(
            "words", pat_str=r"[\s\S]{1,64}", mergeable_ranks=ranks, special_tokens={}
        )
        self._keys = np.zeros(0, np.uint64)
        self._first = np.zeros(0, np.int64)
        self._count = np.zeros(0, np.int64)
        self._again = np.zeros(0, bool)
        self._ids = np.zeros(0, np.int32)

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Subwords:
        """The one of this process, which remembers the words of its earlier tasks."""
        if not _SUBWORDS or _SUBWORDS[0].ranks is not ranks:
            _SUBWORDS[:] = [cls(ranks)]
        return _SUBWORDS[0]

    def _forget(self) -> None:
        """Keeps the words that more than one chunk had, if they are at most half."""
        kept = self._again
        if 2 * np.count_nonzero(kept) > REMEMBERED:
            kept = np.zeros_like(kept)
        first, count = self._first[kept], self._count[kept]
        self._keys, self._count = self._keys[kept], count
        self._first = np.cumsum(count) - count
        self._again = np.zeros(len(count), bool)
        self._ids = self._ids[np.repeat(first - self._first, count) + np.arange(count.sum())]

    def __call__(
        self,
        data: np.ndarray,
        starts: np.ndarray,
        ends: np.ndarray,
        hashes: np.ndarray,
        rows: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all rows, each with an end; their number in each row; words' first ids."""
        if len(self._keys) > REMEMBERED:
            self._forget()
        unique, place, inverse, times = np.unique(
            hashes, return_index=True, return_inverse=True, return_counts=True
        )
        self.counted = unique, times
        at = np.searchsorted(self._keys, unique)
        known = at < len(self._keys)
        known[known] = self._keys[at[known]] == unique[known]
        self._again[at[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            text = data.tobytes()
            encode = self._encoder.encode_ordinary
            found = [
                encode(" " + text[a:b].decode("utf-8", "replace"))
                for a, b in zip(starts[place[new]].tolist(), ends[place[new]].tolist(), strict=True)
            ]
            count = np.array([len(ids) for ids in found], np.int64)
            first = len(self._ids) + np.cumsum(count) - count
            self._ids = np.concatenate(
                [self._ids, np.fromiter(chain.from_iterable(found), np.int32)]
            )
            spot = at[new]
            self._keys = np.insert(self._keys, spot, unique[new])
            self._first = np.insert(self._first, spot, first)
            self._count = np.insert(self._count, spot, count)
            self._again = np.insert(self._again, spot, False)
            at = np.searchsorted(self._keys, unique)
        count, first = self._count[at][inverse], self._first[at][inverse]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self._ids[np.repeat(first - before[:-1], count) + np.arange(before[-1])]
        bounds = before[rows]
        counts = np.insert(count, rows[1:], 1)
        return (
            np.insert(ids, bounds[1:], self.end),
            np.diff(bounds) + 1,
            np.cumsum(counts) - counts,
        )


class Tally:
    """Counts of keys, passed on in parts once there are too many to hold."""

    def __init__(self) -> None:
        self._keys: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self._size = 0

    def add(self, unique: np.ndarray, counts: np.ndarray) -> None:
        self._keys.append(unique)
        self._counts.append(counts)
        self._size += len(unique)
        if self._size > HELD:
            self._merge()

    def _merge(self) -> None:
        if self._keys:
            unique, inverse = np.unique(np.concatenate(self._keys), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate(self._counts), len(unique))
            self._keys, self._counts = [unique], [counts.astype(np.int64)]
            self._size = len(unique)

    def full(self) -> bool:
        return self._size > HELD // 2 and len(self._keys) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        keys, counts = (self._keys or [np.zeros(0)])[0], (self._counts or [np.zeros(0)])[0]
        self._keys, self._counts, self._size = [], [], 0
        return keys.astype(np.uint64).view(np.int64), counts.astype(np.int64)


WORD, PAIR, SAMPLE, SAMPLES = 0, 1, 2, 3


def gathered(docs: DataFrame, ranks, count: bool = True, sample: bool = True) -> DataFrame:
    """Counts of words, pairs of ids and windows, and all windows, told apart by ``kind``.

    ``key`` and ``n`` are what is counted and how often, or the hash of a window and its size;
    ``ids`` are those of a window, see ``id_type``. ``ranks`` is the broadcast vocabulary.
    """
    fields = ["kind", "key", "n", "ids"]

    def counts(kind: int, tally: Tally) -> pa.RecordBatch:
        keys, n = tally.take()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(keys), kind, np.int32)),
                pa.array(keys),
                pa.array(n),
                pa.nulls(len(keys), pa.binary()),
            ],
            fields,
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords.of(ranks.value)
        words, pairs, windows = Tally(), Tally(), 0
        for names, ids, before, sizes in _encoded(batches, subwords):
            if sample:
                key, size, held = _windows(names, ids, before, sizes, subwords.end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(key), SAMPLE, np.int32)),
                        pa.array(key),
                        pa.array(size),
                        pa.array([row.tobytes() for row in held], pa.binary()),
                    ],
                    fields,
                )
            if not count:
                continue
            windows += int(attention.windows_of(sizes).sum())
            words.add(*subwords.counted)
            words.add(np.array([END_WORD], np.uint64), np.array([len(names)]))
            key = before.astype(np.uint64) * np.uint64(subwords.end + 1)
            pairs.add(*np.unique(key + ids.astype(np.uint64), return_counts=True))
            for kind, tally in ((WORD, words), (PAIR, pairs)):
                if tally.full():
                    yield counts(kind, tally)
        if count:
            yield counts(WORD, words)
            yield counts(PAIR, pairs)
            seen = Tally()
            seen.add(np.zeros(1), np.array([windows]))
            yield counts(SAMPLES, seen)

    return _texts(docs).mapInArrow(gather, "kind int, key long, n long, ids binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def _encoded(batches: Iterator[pa.RecordBatch], subwords: Subwords) -> Iterator[tuple]:
    """The names of the documents of a chunk, all their ids, the id before each, and their numbers."""
    hasher = WordHasher()
    for batch in batches:
        names = batch.column(0).fill_null(0).to_numpy()
        for first, last, data, offsets in text_chunks(batch.column(1)):
            data = LOWER[data]
            starts, ends, rows = word_bounds(data, offsets)
            hashes = hasher(data, starts, ends)
            ids, sizes, _ = subwords(data, starts, ends, hashes, rows)
            yield names[first:last], ids, _before(ids, sizes, subwords.end), sizes


def _before(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before


def id_type(end: int) -> type:
    """What holds the ids of windows on disk, one more than they are: 0 is no id."""
    return np.uint16 if end < np.iinfo(np.uint16).max else np.int32


def _windows(
    names: np.ndarray, ids: np.ndarray, before: np.ndarray, sizes: np.ndarray, end: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: a hash of the document's id and the place in it, which deals them out; how
    many ids each has; and those, after the id before them."""
    start, size, _ = attention.windows(sizes)
    text = np.searchsorted(np.cumsum(sizes), start, side="right")
    place = start - (np.cumsum(sizes) - sizes)[text]
    key = mixed(mixed(names[text].astype(np.uint64)) + place.astype(np.uint64))
    spot = np.arange(WINDOW)
    held = np.zeros((len(start), WINDOW + 1), id_type(end))
    held[:, 0] = before[start] + 1
    held[:, 1:] = np.where(
        spot < size[:, None], ids[np.minimum(start[:, None] + spot, len(ids) - 1)] + 1, 0
    )
    return (key >> np.uint64(1)).astype(np.int64), size.astype(np.int64), held


def known_counts(pairs: DataFrame, end: int) -> Counted:
    """The prior of the model. What comes to the driver is bounded by the vocabulary.

    ``pairs`` has ``key``, a pair of ids, and ``n``.
    """
    size = end + 1
    named = pairs.select(
        F.expr(f"cast(key div {size} as int)").alias("a"), (F.col("key") % size).cast("int").alias("b"), "n"
    )
    singles = named.groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size)
    counts[singles["b"].to_numpy()] = singles["n"].to_numpy()
    class_of, place = attention.classes_of(counts), attention.by_count(counts, PAIRED)
    names = pairs.sparkSession.createDataFrame(
        list(zip(range(size), class_of.tolist(), place.tolist())), "id int, class int, place int"
    )
    joined = named
    for end_of in ("a", "b"):
        own = {"id": end_of, "class": f"{end_of}_class", "place": f"{end_of}_place"}
        joined = joined.join(F.broadcast(names.withColumnsRenamed(own)), end_of)
    after, to_class, between = (
        np.zeros(shape, FLOAT) for shape in ((CLASSES, size), (size, CLASSES), (PAIRED, PAIRED))
    )
    both = joined.where((F.col("a_place") < PAIRED) & (F.col("b_place") < PAIRED))
    for table, source, row, column in (
        (after, joined, "a_class", "b"),
        (to_class, joined, "a", "b_class"),
        (between, both, "a_place", "b_place"),
    ):
        sums = source.groupBy(row, column).agg(F.sum("n").alias("n")).toArrow()
        table[sums[row].to_numpy(), sums[column].to_numpy()] = sums["n"].to_numpy()
    return attention.counted(counts, class_of, after, to_class, between)


def packed(samples: DataFrame, parts: int, of_id: type, ranks=None) -> DataFrame:
    """A row for each part of all windows: ``n`` and the ``ids`` of its windows, compressed.

    A part's windows come from all over the corpus and stand in the order of their hashes.
    ``samples`` has a row for each window, or, with the broadcast vocabulary ``ranks``, documents.
    Their tasks cut the windows and pack them in one Python worker, so that no window is a row.
    """

    def rows(keys: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        part = hash_long(keys) % parts
        order = np.argsort(part, kind="stable")
        part, keys, held = part[order], keys[order], held[order]
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[edges[:-1]].astype(np.int32)),
                pa.array(np.diff(edges)),
                pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([_squeezed(held[a:b]) for a, b in spans], pa.binary()),
            ],
            ["part", "n", "keys", "ids"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if ranks is None:
            for batch in batches:
                yield batch.column(0).to_numpy(), _unjoined(batch.column(1).to_pylist(), of_id)
            return
        subwords = Subwords.of(ranks.value)
        for chunk in _encoded(batches, subwords):
            keys, _, held = _windows(*chunk, subwords.end)
            yield keys, held

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, n = [], [], 0
        for some in cut(batches):
            keys.append(some[0])
            held.append(some[1])
            n += len(some[0])
            if n >= PACKED:
                yield rows(np.concatenate(keys), np.concatenate(held))
                keys, held, n = [], [], 0
        if n:
            yield rows(np.concatenate(keys), np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], []
        for batch in batches:
            keys.extend(np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist())
            for n, ids in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                held.append(_unsqueezed(ids, n, of_id))
        if held:
            keys, held = np.concatenate(keys), np.concatenate(held)
            held = held[np.lexsort((held[:, 1], keys))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(held)], pa.int64()), pa.array([_squeezed(held)], pa.binary())],
                ["n", "ids"],
            )

    source = samples.select("key", "ids") if ranks is None else _texts(samples)
    return (
        source.mapInArrow(pack, "part int, n long, keys binary, ids binary")
        .repartitionById(parts, "part")
        .mapInArrow(merge, "n long, ids binary")
    )


def _unjoined(ids: list[bytes], of_id: type) -> np.ndarray:
    return np.frombuffer(b"".join(ids), of_id).reshape(len(ids), WINDOW + 1)


def _squeezed(held: np.ndarray) -> bytes:
    """Rows of ids compressed, the first bytes of all ids before the second ones."""
    planes = held.reshape(-1, 1).view(np.uint8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(ids: bytes, n: int, of_id: type) -> np.ndarray:
    width = np.dtype(of_id).itemsize
    planes = pa.decompress(ids, n * (WINDOW + 1) * width, codec="zstd", asbytes=True)
    planes = np.frombuffer(planes, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(of_id).reshape(n, WINDOW + 1)


def trained(
    docs: DataFrame, ranks, known, windows: int, rates: tuple[float, ...] = RATES
) -> np.ndarray:
    """The weights after a round for each rate.

    ``ranks`` and ``known`` are the broadcast vocabulary and prior, and ``windows`` the number of
    those of ``docs``.
    """
    parts = buckets_for(windows, PART)
    of_id = id_type(len(known.value.class_of) - 1)
    dealt = staged(packed(docs, parts, of_id, ranks), "windows")
    weights = attention.flat(attention.fresh())

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for values, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                add = np.frombuffer(values, np.float64) * count
                total, n = add if total is None else total + add, n + count
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([(total / n).tobytes()], pa.binary()), pa.array([n], pa.int64())],
                ["weights", "n"],
            )

    for number, rate in enumerate(rates):
        step = _trainer(weights, known, rate, number, of_id)
        means = (
            dealt.mapInArrow(step, "weights binary, n long")
            .repartition(math.isqrt(parts) + 1)
            .mapInArrow(mean, "weights binary, n long")
            .collect()
        )
        if means:
            n = sum(row["n"] for row in means)
            weights = sum(np.frombuffer(row["weights"], np.float64) * row["n"] for row in means) / n
    return weights


def _trainer(weights: np.ndarray, known, rate: float, number: int, of_id: type):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sample = _unsqueezed(ids, n, of_id).astype(np.int32) - 1
                after = attention.train(attention.unflat(weights), known.value, sample, rate, number)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([attention.flat(after).astype(np.float64).tobytes()], pa.binary()),
                        pa.array([n], pa.int64()),
                    ],
                    ["weights", "n"],
                )

    return train


def score(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """One row for each row of ``docs``.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(ranks)
    learned = docs.where(~held_out())
    stats = staged(gathered(learned, vocabulary, sample=False), "gathered")
    words = staged(
        stats.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")), "words"
    )
    pairs = staged(
        stats.where(F.col("kind") == PAIR).groupBy("key").agg(F.sum("n").alias("n")), "pairs"
    )
    known = context.broadcast(known_counts(pairs, max(ranks.values()) + 1))
    windows = stats.where(F.col("kind") == SAMPLES).agg(F.sum("n")).first()[0] or 0
    weights = context.broadcast(attention.unflat(trained(learned, vocabulary, known, windows)))
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, different = totals["n"] or 0, totals["v"]
    least = FREQUENT * tokens
    frequent = words.where(F.col("n") >= least).toArrow().sort_by([("key", "ascending")])
    common = context.broadcast((frequent["key"].to_numpy(), frequent["n"].to_numpy()))
    smooth = tokens + 0.1 * (different + 1)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["text"].cast("string").alias("text"),
    ).mapInArrow(
        _scorer(vocabulary, known, weights, common, smooth),
        "row long, doc_id long, key long, n long, tokens long, known long, base double, score double",
    )
    rare = words.where(F.col("n") < least).select(F.col("key").alias("_key"), F.col("n").alias("c"))
    count = F.coalesce("c", F.lit(0))
    of_word = F.col("n") * F.log10((count + 0.1) / smooth)
    return (
        rows.join(rare, F.col("key") == F.col("_key"), "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("tokens").alias("n_tokens"),
            F.sum(F.col("known") + F.when(count > 0, F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.when(F.col("n") > 0, of_word).otherwise(0)).alias("base_score"),
            F.sum("score").alias("score"),
        )
        .select(
            "doc_id",
            held_out().alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(tokens).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )
    )


def _scorer(vocabulary, known, weights, common, smooth: float):
    """Scores documents: a row for each, and one for each of its rarer words to be joined.

    The row of a document has no word (``n`` is 0) and a key that spreads them.
    """
    fields = ["row", "doc_id", "key", "n", "tokens", "known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, subwords = WordHasher(), Subwords.of(vocabulary.value)
        keys, counts = common.value
        logs = np.log10((counts + 0.1) / smooth)
        whole = np.log(WHOLE * counts / max(1, counts.sum()))
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(2)):
                data = LOWER[data]
                starts, ends, rows = word_bounds(data, offsets)
                hashes = hasher(data, starts, ends)
                ids, sizes, firsts = subwords(data, starts, ends, hashes, rows)
                before = _before(ids, sizes, subwords.end)
                by_id = attention.token_scores(weights.value, known.value, before, ids, sizes)
                n = last - first
                text = np.insert(np.repeat(np.arange(n), np.diff(rows)), rows[1:], np.arange(n))
                word = np.insert(hashes, rows[1:], np.uint64(END_WORD)).view(np.int64)
                at = np.minimum(np.searchsorted(keys, word), max(0, len(keys) - 1))
                hit = keys[at] == word if len(keys) else np.zeros(len(word), bool)
                base = np.bincount(text[hit], logs[at[hit]], n)
                found = np.bincount(text[hit], minlength=n)
                by_word = np.add.reduceat(by_id, firsts) + math.log1p(-WHOLE)
                by_word[hit] = np.logaddexp(by_word[hit], whole[at[hit]])
                scores = np.bincount(text, by_word, n) / math.log(10)
                names = batch.column(0).slice(first, n).to_numpy()
                yield _rows(
                    [
                        names,
                        batch.column(1).slice(first, n),
                        mixed(names.astype(np.uint64)).view(np.int64),
                        np.zeros(n, np.int64),
                        np.diff(rows) + 1,
                        found,
                        base,
                        scores,
                    ],
                    fields,
                )
                text, word = text[~hit], word[~hit]
                order = np.lexsort((word, text))
                text, word = text[order], word[order]
                edge = np.ones(len(text), bool)
                edge[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
                edge = np.flatnonzero(edge)
                zero = np.zeros(len(edge), np.int64)
                yield _rows(
                    [
                        names[text[edge]],
                        pa.nulls(len(edge), pa.int64()),
                        word[edge],
                        np.diff(np.append(edge, len(text))),
                        *(zero, zero, zero.astype(float), zero.astype(float)),
                    ],
                    fields,
                )

    return run


def _rows(columns: list, fields: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], fields
    )
