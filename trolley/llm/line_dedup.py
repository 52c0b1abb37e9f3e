"""Remove lines or paragraphs that occurred before, in the same document or an earlier one.

A unit is a line, or a paragraph where ``separator`` is a blank line. Units are compared with
ASCII letters in lower case and white space collapsed, by a digest of 128 bits. Of the units
with one digest the earliest stays: the one of the smallest doc_id, and there the first. The
others go, with the separator that follows them; their places in the original text are kept.

Defined results: units under ``min_words`` words are not judged. A null text stays null. Null
ids come first. Rows that share id and text count as one document and get the same result; rows
that share only the id are ranked by a digest of their text. A very common unit costs one row
for each place where it stands, dealt out by joins that can be split. An empty table gives an
empty result. Columns besides ``doc_id`` and ``text`` take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.hashing import LOWER, WordHasher, mixed, text_chunks, word_bounds
from trolley.llm.stages import staged

MIN_WORDS = 5
_UNITS = "doc_id long, text_key string, high long, low long, start long, end long, words long"


def _segments(
    data: np.ndarray, offsets: np.ndarray, separator: bytes
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end, with the separator, of each unit, and its row."""
    marks = np.flatnonzero(data == separator[0])
    for at, byte in enumerate(separator[1:], 1):
        marks = marks[marks + at < len(data)]
        marks = marks[data[marks + at] == byte]
    row = np.searchsorted(offsets, marks, side="right") - 1
    marks = marks[marks + len(separator) <= offsets[row + 1]]
    if len(separator) > 1 and len(marks):
        kept, last = [], -len(separator)
        for mark in marks.tolist():
            if mark >= last + len(separator):
                kept.append(mark)
                last = mark
        marks = np.array(kept)
    ends = np.unique(np.concatenate([marks + len(separator), offsets[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def units(docs: DataFrame, separator: str = "\n", min_words: int = MIN_WORDS) -> DataFrame:
    """Digest and place, in characters of the text, of each unit of ``min_words`` or more."""
    mark = separator.encode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(2)):
                starts, ends, of = _segments(data, offsets, mark)
                data = LOWER[data]
                begin, finish, _ = word_bounds(data, np.append(starts, len(data)))
                hashes = hasher(data, begin, finish)
                word = np.searchsorted(begin, np.append(starts, len(data)))
                counts = np.diff(word)
                some = counts >= max(min_words, 1)
                starts, ends, of = starts[some], ends[some], of[some]
                place = np.arange(len(hashes)) - np.repeat(word[:-1], counts)
                digests = []
                for salt in (1, 2):
                    turned = mixed(hashes * np.uint64(2 * salt + 1) + place.astype(np.uint64))
                    sums = np.zeros(len(turned) + 1, np.uint64)
                    np.cumsum(mixed(turned + np.uint64(salt)), out=sums[1:])
                    total = (sums[word[1:]] - sums[word[:-1]])[some]
                    digests.append(mixed(total + counts[some].astype(np.uint64)).view(np.int64))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = chars[offsets[of]]
                rows = pa.array(of + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        *(pa.array(d) for d in digests),
                        pa.array(chars[starts] - base),
                        pa.array(chars[ends] - base),
                        pa.array(counts[some]),
                    ],
                    ["doc_id", "text_key", "high", "low", "start", "end", "words"],
                )

    return (
        docs.where("text is not null")
        .select(
            docs["doc_id"].cast("long").alias("doc_id"),
            F.sha2("text", 256).alias("text_key"),
            "text",
        )
        .mapInArrow(cut, _UNITS)
    )


def repeated_units(found: DataFrame) -> DataFrame:
    """The units that are not the earliest with their digest.

    What is known of each digest is written before the join: adaptive execution splits a join
    of two plain shuffles where a unit is very common, but not one with an aggregate in it.
    """
    place = F.struct("doc_id", "text_key", "start")
    earliest = staged(
        found.groupBy(F.col("high").alias("_high"), F.col("low").alias("_low"))
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1"),
        "earliest",
    )
    return found.join(
        earliest, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low"))
    ).where(~place.eqNullSafe(F.col("_first")))


def remove_repeats(
    docs: DataFrame, separator: str = "\n", min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, text without its repeated units, and ``removed``, their places in the original."""
    spans = (
        repeated_units(staged(units(docs, separator, min_words), "units"))
        .select("doc_id", "text_key", F.struct("start", "end").alias("span"))
        .distinct()
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.array_sort(F.collect_list("span")).alias("removed"))
    )
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    marked = rows.join(
        spans,
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.sha2("text", 256) == F.col("_key")),
        "left",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            kept = []
            for text, gone in zip(texts, removed, strict=True):
                if gone:
                    at, pieces = 0, []
                    for span in gone:
                        pieces.append(text[at : span["start"]])
                        at = span["end"]
                    text = "".join([*pieces, text[at:]])
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), batch.column(2)],
                ["doc_id", "text", "removed"],
            )

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return marked.select("doc_id", "text", F.coalesce("removed", empty).alias("removed")).mapInArrow(
        cut, "doc_id long, text string, removed array<struct<start:bigint,end:bigint>>"
    )
