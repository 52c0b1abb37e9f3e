"""Remove passages that occurred before, by hashing the units that lines are cut into.

A passage may begin and end anywhere in a line, so lines are cut where their words say, and equal
passages are cut alike. Each word has a number from its own length in bytes and its neighbours';
a line is cut after a word whose number is below those of the ``REACH`` words before it and not
above those of the ``REACH`` words after it. The units, of some five words each, are compared with
ASCII letters in lower case and white space collapsed, by a digest. Of units with one digest the
earliest stays: the one of the smallest doc_id, and there the first. Runs of other units go where
they have ``LEAST`` words or more in all; their places in the original text are kept. A passage
of over 50 words has so many in whole units, and repeated phrases and lines that are shorter stay.

First only digests are counted. Then the units whose digest occurs more than once meet, and only
texts that may have a run are shuffled.

Defined results: a null text stays null. Null ids come first. Rows that share id and text count
as one document and get the same result; rows that share only the id are ranked by a digest of
their text. A run ends with the text, but not with the line. A very common unit costs one row for
each place where it stands, dealt out by joins that can be split. Digests have 64 bits: in a
very large corpus two units may share one, but not all of a run. An empty table gives an empty
result. Columns besides ``doc_id`` and ``text`` take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.filters import bitmaps_for, split_by_filter
from trolley.llm.hashing import LOWER, WordHasher, mixed, text_chunks, word_bounds
from trolley.llm.stages import staged

REACH, LEAST = 2, 36
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _cut(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Digests, number of words, first and end byte of all units, and each row's first unit."""
    begin, finish, rows = word_bounds(data, offsets)
    n = len(begin)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(len(offsets), np.int64)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(n, bool)
    last[:-1] = breaks[begin[1:]] > breaks[finish[:-1]]
    last[rows[1:][rows[1:] > rows[:-1]] - 1] = True
    stop = np.flatnonzero(last | _low(finish - begin, rows))
    start = np.concatenate([[0], stop[:-1] + 1])
    counts = stop - start + 1
    words = hasher(data, begin, finish)
    place = np.arange(n) - np.repeat(start, counts)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(words * np.uint64(3) + place.astype(np.uint64)), out=sums[1:])
    digests = mixed(sums[stop + 1] - sums[start] + counts.astype(np.uint64)).view(np.int64)
    return digests, counts, begin[start], finish[stop], np.searchsorted(start, rows)


def _low(lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether the number of each word is below those around it, in the same text.

    Words of other texts are put out of reach by places without a word between the texts.
    """
    of = np.searchsorted(rows, np.arange(len(lengths)), side="right") - 1
    at = np.arange(len(lengths)) + (REACH + 1) * (of + 1)
    size = len(lengths) + (REACH + 1) * (len(rows) + 1)
    spaced, numbers = np.zeros(size, np.int64), np.full(size, 31)
    spaced[at] = lengths
    number = (7 * lengths + 11 * spaced[at + 1] + 13 * spaced[at - 1]) % 31
    numbers[at] = number
    low = np.ones(len(lengths), bool)
    for away in range(1, REACH + 1):
        low &= (number < numbers[at - away]) & (number <= numbers[at + away])
    return low


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.xxhash64(F.sha2("text", 256)).alias("key"),
        docs["text"].cast("string").alias("text"),
    )


def unit_digests(rows: DataFrame) -> DataFrame:
    """doc_id, key and the digests and numbers of words of all units of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(2)):
                digests, counts, _, _, firsts = _cut(hasher, LOWER[data], offsets)
                lists = pa.array(firsts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(first, last - first) for i in (0, 1)),
                        pa.ListArray.from_arrays(lists, pa.array(digests)),
                        pa.ListArray.from_arrays(lists, pa.array(counts.astype(np.int32))),
                    ],
                    ["doc_id", "key", "digests", "words"],
                )

    return rows.where("text is not null").mapInArrow(
        cut, "doc_id long, key long, digests array<long>, words array<int>"
    )


def repeated_runs(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, key and the first and end unit of the runs that go from each text, where any do."""
    units = staged(unit_digests(rows), "units")
    repeated = staged(
        units.select(F.explode("digests").alias("digest")).groupBy("digest").count().where("count > 1"),
        "repeated",
    )
    placed = units.select(
        "doc_id", "key", F.posexplode(F.arrays_zip("digests", "words")).alias("unit", "of")
    ).select("doc_id", "key", "unit", F.col("of.digests").alias("digest"), F.col("of.words").alias("words"))
    maybe, _ = split_by_filter(placed, repeated, "digest", bitmaps_for(repeated.count()))
    found = staged(maybe.join(repeated.select("digest"), "digest"), "found")
    place = F.struct("doc_id", "key", "unit")
    earliest = staged(
        found.groupBy(F.col("digest").alias("_digest")).agg(F.min(place).alias("_first")), "earliest"
    )
    later = (
        found.join(earliest, F.col("digest") == F.col("_digest"))
        .where(~place.eqNullSafe(F.col("_first")))
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("unit", "words")).alias("units"), F.sum("words").alias("n"))
        .where(F.col("n") >= least)
        .select("doc_id", "key", F.array_sort("units").alias("units"))
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, found = [], [], []
            for row in range(batch.num_rows):
                units = batch.column(2)[row].values
                unit, words = (units.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                edge = np.flatnonzero(np.diff(unit) != 1) + 1
                first = np.concatenate([[0], edge])
                end = np.append(edge, len(unit))
                sums = np.concatenate([[0], np.cumsum(words)])
                long = sums[end] - sums[first] >= least
                if long.any():
                    ids.append(batch.column(0)[row].as_py())
                    keys.append(batch.column(1)[row].as_py())
                    pairs = zip(unit[first[long]].tolist(), (unit[end[long] - 1] + 1).tolist())
                    found.append([{"start": a, "end": b} for a, b in pairs])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(found, kind)],
                ["id", "of", "runs"],
            )

    return staged(later.mapInArrow(runs, f"id long, of long, runs {_SPANS}"), "runs")


def remove_shared(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text without its repeated passages, and ``removed``, their places in the original."""
    rows = _rows(docs)
    runs = repeated_runs(rows, least)
    touched, others = split_by_filter(
        rows, runs.select(F.col("of").alias("key")), "key", bitmaps_for(runs.count())
    )
    marked = touched.join(
        runs, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")), "left"
    ).select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            kept, removed = [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = []
                if own:
                    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
                    _, _, begin, finish, _ = _cut(hasher, data, np.array([0, len(data)]))
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    at, pieces = 0, []
                    for run in own:
                        start, end = int(chars[begin[run["start"]]]), int(chars[finish[run["end"] - 1]])
                        gone.append({"start": start, "end": end})
                        pieces.append(text[at:start])
                        at = end
                    text = "".join([*pieces, text[at:]])
                kept.append(text)
                removed.append(gone)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(removed, kind)],
                ["doc_id", "text", "removed"],
            )

    unchanged = others.select("doc_id", "text", F.array().cast(_SPANS).alias("removed"))
    return marked.mapInArrow(cut, f"doc_id long, text string, removed {_SPANS}").unionByName(unchanged)
