"""Remove passages that occurred before, wherever they stand, and lines that occurred before.

Words are compared as in ``line_dedup``. A window is a run of ``passage`` words of one text,
across line breaks. Of equal windows the earliest stays: the one of the smallest doc_id, and
there the first. The words of the others go, except those that belong to the earliest itself
where the two overlap, so that of a text that repeats within itself one copy stays. Lines of
``min_words`` or more are judged as in ``line_dedup``, on the same original text; both kinds of
places are merged. A passage goes without the white space around it.

No row is made for every word. A window's signature is the least hash of its runs of half as
many words, so equal windows share it, and only windows whose signature stands in two places or
more are written and compared, by digests of 128 bits.

Defined results: as in ``line_dedup``; rows that share only the id are ranked by a digest of
their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.hashing import LOWER, WordHasher, mixed, text_chunks, word_bounds
from trolley.llm.line_dedup import MIN_WORDS, repeated_units, units
from trolley.llm.stages import staged

PASSAGE = 50
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _runs(words: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from running sums."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    up, down = np.full((2, len(words)), 1, np.uint64)
    up[1:], down[1:] = factor, pow(factor, -1, 1 << 64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mixed(words ^ np.uint64(factor)) * np.cumprod(up), out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * np.cumprod(down)[: len(words) - size + 1])


def _sliding(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values, span = of(values[:-span], values[span:]), span * 2
    rest = width - span
    return of(values[:-rest], values[rest:]) if rest else values


class _Windows:
    """Signatures of the windows of a chunk, and which of them lie within one text."""

    def __init__(self, hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, passage: int):
        begin, finish, self.rows = word_bounds(data, offsets)
        self.words = hasher(data, begin, finish)
        half = passage // 2
        width = passage - half + 1
        self.grams = _runs(self.words, half, _FACTORS[0]) | np.uint64(1)
        self.signatures = _sliding(self.grams, width, np.minimum)
        at = np.arange(len(self.signatures))
        self.of = np.searchsorted(self.rows, at, side="right") - 1
        self.whole = at + passage <= self.rows[self.of + 1]
        self.width = width

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of each place that gives a window its signature."""
        if not len(self.signatures):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        edge = np.zeros(self.width - 1, np.uint64)
        inside = np.where(self.whole, self.signatures, np.uint64(0))
        most = _sliding(np.concatenate([edge, inside, edge]), self.width, np.maximum)
        at = np.flatnonzero(most == self.grams)
        return np.searchsorted(self.rows, at, side="right") - 1, self.grams[at]


def _signatures(docs: DataFrame, passage: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, _, data, offsets in text_chunks(batch.column(2)):
                of, signature = _Windows(hasher, LOWER[data], offsets, passage).chosen()
                order = np.lexsort((signature, of))
                of, signature = of[order], signature[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (signature[1:] != signature[:-1])
                at = np.flatnonzero(new)
                rows = pa.array(of[at] + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(signature[at].view(np.int64)),
                        pa.array(np.diff(np.append(at, len(of)))),
                    ],
                    ["doc_id", "key", "signature", "places"],
                )

    return docs.mapInArrow(cut, "doc_id long, key long, signature long, places long")


def _candidates(docs: DataFrame, passage: int) -> DataFrame:
    """Digest and first word of each window whose signature is among its text's repeated ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(2)):
                windows = _Windows(hasher, LOWER[data], offsets, passage)
                listed = batch.column(3).slice(first, last - first).flatten()
                repeated = np.unique(listed.to_numpy(zero_copy_only=False)).view(np.uint64)
                at = np.flatnonzero(windows.whole & np.isin(windows.signatures, repeated))
                digests = [_runs(windows.words, passage, f)[at] for f in _FACTORS[1:]]
                rows = pa.array(windows.of[at] + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(d.view(np.int64)) for d in digests),
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array((at - windows.rows[windows.of[at]]).astype(np.int32)),
                    ],
                    ["high", "low", "doc_id", "key", "start"],
                )

    return docs.mapInArrow(cut, "high long, low long, doc_id long, key long, start int")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """doc_id, key, and the words from ``start`` to before ``end`` of each repeated window."""
    rows = docs.where("text is not null").select(
        docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.sha2("text", 256)).alias("key"), "text"
    )
    signatures = staged(_signatures(rows, passage), "signatures")
    repeated = staged(
        signatures.groupBy("signature").agg(F.sum("places").alias("n")).where("n > 1").drop("n"),
        "repeated",
    )
    of_text = (
        signatures.join(repeated, "signature")
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.collect_set("signature").alias("signatures"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    found = staged(
        _candidates(rows.join(of_text, same).select("doc_id", "key", "text", "signatures"), passage),
        "windows",
    )
    place = F.struct("doc_id", "key", "start")
    earliest = staged(
        found.groupBy(F.col("high").alias("_high"), F.col("low").alias("_low"))
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1"),
        "first_windows",
    )
    own = F.col("_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_first.key") == F.col("key"))
    return (
        found.join(earliest, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")))
        .where(~place.eqNullSafe(F.col("_first")))
        .select(
            "doc_id",
            "key",
            F.when(own, F.greatest("start", F.col("_first.start") + passage))
            .otherwise(F.col("start"))
            .alias("start"),
            (F.col("start") + passage).alias("end"),
        )
    )


def _merged(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that at least one of the spans covers, as spans that do not touch."""
    steps = np.zeros(size + 2, np.int64)
    np.add.at(steps, starts + 1, 1)
    np.add.at(steps, ends + 1, -1)
    edges = np.diff((np.cumsum(steps) > 0).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def remove_passages(docs: DataFrame, passage: int = PASSAGE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without what is repeated, and ``removed``, its places in the original."""
    placed = units(docs, min_words=min_words).select(
        "doc_id", F.xxhash64("text_key").alias("text_key"), "high", "low", "start", "end"
    )
    line = repeated_units(staged(placed, "units")).select(
        "doc_id", F.col("text_key").alias("key"), F.lit(True).alias("line"), "start", "end"
    )
    window = repeated_passages(docs, passage).select(
        "doc_id", "key", F.lit(False).alias("line"), "start", "end"
    )
    spans = (
        line.unionByName(window)
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.collect_list(F.struct("line", "start", "end")).alias("spans"))
    )
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    marked = rows.join(
        spans,
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & (F.xxhash64(F.sha2("text", 256)) == F.col("_key")),
        "left",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for row in range(batch.num_rows):
                text, spans = batch.column(1)[row].as_py(), batch.column(2)[row].values
                gone = []
                if spans is not None and len(spans):
                    line, start, end = (
                        spans.field(k).to_numpy(zero_copy_only=False) for k in range(3)
                    )
                    line = line.astype(bool)
                    data = np.frombuffer(text.encode(), np.uint8)
                    begin, finish, _ = word_bounds(data, np.array([0, len(data)]))
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    first, last = _merged(start[~line], end[~line], len(begin))
                    first, last = _merged(
                        np.concatenate([start[line], chars[begin[first]]]),
                        np.concatenate([end[line], chars[finish[last - 1]]]),
                        len(text),
                    )
                    gone = list(zip(first.tolist(), last.tolist(), strict=True))
                    at, pieces = 0, []
                    for since, until in gone:
                        pieces.append(text[at:since])
                        at = until
                    text = "".join([*pieces, text[at:]])
                kept.append(text)
                removed.append([{"start": since, "end": until} for since, until in gone])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(removed, kind)],
                ["doc_id", "text", "removed"],
            )

    return marked.select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, text string, removed array<struct<start:bigint,end:bigint>>"
    )
