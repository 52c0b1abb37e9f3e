"""Tell the language of texts from their subwords.

A word is a run of letters, here ASCII letters in lower case and all bytes beyond ASCII; its
subwords are itself and the runs of two to five bytes of it and the spaces around it. Each is
hashed to a vector, a text is the average of the vectors of all its subwords, and a linear softmax
over that average gives the languages' probabilities. Vectors and softmax are trained together by
stochastic gradient descent in numpy, with steps that adapt to each weight.

A fifth of the examples takes no part in training. They set the temperature of the softmax, so
that a score of 0.9 means nine in ten right, and the score below which an answer is rejected: the
least from which on at most ``WRONG`` of their answers are wrong.

The model is fitted on at most ``FIT_ROWS`` labelled rows, drawn by a hash of their ids from the
``MOST_LANGUAGES`` most frequent languages in equal parts as far as there are so many, and on up to
``FIT_WORDS`` words of each, spread evenly over the whole text (words over ``FIT_BYTES`` bytes are
not drawn). A prediction takes all subwords of the whole text.

Since the softmax is linear, training ends with one row of numbers for each hashed subword, and a
text's logits are the average of these rows. Tasks add them up once for each distinct word of
about a megabyte of texts.

Defined results: null texts and those without a letter are ``und`` with score 0, and so is every
text where there was nothing to learn from. Rows with a null language or id teach nothing. Ties go
to the language that comes first by code point. Repeated rows are learned once and each get their
answer. An empty table gives an empty result. Columns besides ``doc_id``, ``text`` and, for
fitting, ``lang`` take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.hashing import LOWER, WordHasher, mixed, text_chunks, word_bounds

UNKNOWN = "und"
FIT_ROWS, FIT_WORDS, FIT_BYTES = 4_000, 64, 64
MOST_LANGUAGES = 200
#: A second example of each row, so that short texts are learned as well.
FEW_WORDS = 6
BUCKET_BITS, WIDTH, PASSES, RATE = 16, 16, 3, 0.3
WRONG = 0.01
SHORTEST, LONGEST = 2, 5
#: Letters in lower case; every other byte becomes a space.
LETTERS = np.where((np.arange(256) >= 128) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 32).astype(np.uint8)
_BYTE = np.random.default_rng(0x1A46).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = 0x9E3779B97F4A7C15
_DRAWN = 1_000_000_000


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each word, and how many each word has."""
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    width = ends - starts + 2
    first = np.cumsum(width) - width
    own = np.repeat(np.arange(len(starts)), width)
    at = np.arange(width.sum()) - first[own]
    edge = (at == 0) | (at == width[own] - 1)
    padded = np.where(edge, np.uint8(32), data[np.minimum(starts[own] + np.maximum(at - 1, 0), len(data) - 1)])
    value = _BYTE[padded]
    runs, words = value.copy(), [np.arange(len(starts))]
    found = []
    for n in range(2, LONGEST + 1):
        runs = runs[:-1] + value[n - 1 :] * np.uint64(pow(_POWER, n - 1, 1 << 64))
        inside = np.flatnonzero(at[: len(runs)] + n <= width[own[: len(runs)]])
        if n >= SHORTEST:
            found.append(bucket(runs[inside] + np.uint64(n)))
            words.append(own[inside])
    whole = bucket(WordHasher()(padded, first + 1, first + width - 1))
    of = np.concatenate(words)
    order = np.argsort(of, kind="stable")
    return np.concatenate([whole, *found])[order], np.bincount(of, minlength=len(starts))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    letters = LETTERS[data]
    return letters, *word_bounds(letters, offsets)


def _examples(texts: pa.Array) -> Iterator[list[bytes]]:
    """Buckets of the words drawn from each text, many and few."""
    for first, last, data, offsets in text_chunks(texts):
        letters, starts, ends, rows = _words(data, offsets)
        for row in range(last - first):
            own = np.arange(rows[row], rows[row + 1])
            own = own[ends[own] - starts[own] <= FIT_BYTES]
            drawn = []
            for most in (FIT_WORDS, FEW_WORDS):
                some = own[np.linspace(0, len(own) - 1, min(most, len(own))).astype(int)]
                if len(some):
                    drawn.append(subwords(letters, starts[some], ends[some])[0].tobytes())
            yield drawn


@dataclass
class Model:
    """A row of logits for each bucket, the languages, the temperature and the least score."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accepted_from: float = 0.5

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = (logits + self.bias) / self.temperature
        grown = np.exp(scaled - scaled.max(1, keepdims=True))
        return grown / grown.sum(1, keepdims=True)

    def logits(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The averages of the texts' rows, for one chunk after another; zeros without a word."""
        hasher = WordHasher()
        for first, last, data, offsets in text_chunks(texts):
            letters, starts, ends, rows = _words(data, offsets)
            _, one, same = np.unique(hasher(letters, starts, ends), return_index=True, return_inverse=True)
            found, counts = subwords(letters, starts[one], ends[one])
            sums = np.zeros((last - first, len(self.languages)))
            n = np.zeros(last - first)
            if len(starts):
                per_word = np.add.reduceat(
                    self.table[found], np.cumsum(counts) - counts, axis=0, dtype=np.float64
                )
                filled = np.flatnonzero(np.diff(rows))
                sums[filled] = np.add.reduceat(per_word[same], rows[filled], axis=0)
                n[filled] = np.add.reduceat(counts[same], rows[filled])
            yield sums / np.maximum(n, 1)[:, None]


def train(examples: list[np.ndarray], labels: np.ndarray, languages: list[str], seed: int = 13) -> Model:
    """Vectors and softmax, trained on four fifths of the examples and calibrated on the rest."""
    rng = np.random.default_rng(seed)
    size, k = 1 << BUCKET_BITS, len(languages)
    vectors = rng.uniform(-1, 1, (size, WIDTH)) / WIDTH
    weights, bias = np.zeros((WIDTH, k)), np.zeros(k)
    seen_v, seen_w, seen_b = np.full(size, 1e-6), np.full((WIDTH, k), 1e-6), np.full(k, 1e-6)
    parts = [np.unique(e, return_counts=True) for e in examples]
    calibrating = np.arange(len(examples)) // 2 % 5 == 4
    if calibrating.all() or not calibrating.any():
        calibrating = np.zeros(len(examples), bool)
    for _ in range(PASSES):
        for i in rng.permutation(np.flatnonzero(~calibrating)).tolist():
            at, often = parts[i]
            share = often / often.sum()
            mean = share @ vectors[at]
            logits = mean @ weights + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[i]] -= 1
            pull = weights @ error
            step = np.outer(mean, error)
            seen_w += step * step
            seen_b += error * error
            seen_v[at] += share * share * (pull @ pull) / WIDTH
            vectors[at] -= RATE * (share / np.sqrt(seen_v[at]))[:, None] * pull
            weights -= RATE * step / np.sqrt(seen_w)
            bias -= RATE * error / np.sqrt(seen_b)
    model = Model(languages, (vectors @ weights).astype(np.float32), bias)
    if calibrating.any():
        held = np.flatnonzero(calibrating).tolist()
        logits = np.array([parts[i][1] @ model.table[parts[i][0]] / parts[i][1].sum() for i in held])
        calibrate(model, logits, labels[calibrating])
    return model


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray) -> None:
    """Set the temperature of least log loss, and the least score that is accepted."""
    rows = np.arange(len(labels))

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -np.log(np.maximum(model.probabilities(logits)[rows, labels], 1e-12)).mean()

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    p = model.probabilities(logits)
    score = p.max(1)
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum((p.argmax(1) != labels)[order])
    ends = np.append(np.diff(score[order]) < 0, True)
    good = np.flatnonzero(ends & (wrong <= WRONG * (rows + 1)))
    least = score[order][good[-1]] if len(good) else 1.0
    model.accepted_from = float(max(0.5, least)) if wrong[-1] else 0.5


def fit(labelled: DataFrame) -> Model | None:
    """The model of a bounded sample of rows of doc_id, text and lang; None without any."""
    known = labelled.select(
        labelled["doc_id"].cast("long").alias("doc_id"),
        labelled["text"].cast("string").alias("text"),
        labelled["lang"].cast("string").alias("lang"),
    ).where("doc_id is not null and lang is not null and text is not null")
    counts = (
        known.groupBy("lang")
        .agg(F.approx_count_distinct("doc_id").alias("count"))
        .orderBy(F.desc("count"), "lang")
        .limit(MOST_LANGUAGES)
        .collect()
    )
    if not counts:
        return None
    quota = 0.9 * FIT_ROWS / len(counts)
    shares = known.sparkSession.createDataFrame(
        [(r.lang, int(_DRAWN * min(1.0, quota / r["count"]))) for r in counts], "_lang string, below long"
    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = pa.array(list(_examples(batch.column(1))), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), drawn], ["key", "lang", "drawn"]
            )

    sample = (
        known.join(F.broadcast(shares), F.col("lang") == F.col("_lang"))
        .where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(_DRAWN)) < F.col("below"))
        .select(F.xxhash64("doc_id", "lang", "text").alias("key"), "text", "lang")
        .mapInArrow(take, "key long, lang string, drawn array<binary>")
        .where(F.size("drawn") == 2)
        .dropDuplicates(["key"])
        .orderBy("key")
        .limit(FIT_ROWS)
        .toArrow()
    )
    languages = sorted(set(sample["lang"].to_pylist()))
    if not languages:
        return None
    place = {language: i for i, language in enumerate(languages)}
    examples = [np.frombuffer(b, np.int32) for row in sample["drawn"].to_pylist() for b in row]
    labels = np.repeat([place[language] for language in sample["lang"].to_pylist()], 2)
    return train(examples, labels, languages)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row."""
    text = docs["text"].cast("string")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), has_letter(text).alias("told")
    )
    if model is None:
        return rows.select(
            "doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
        )
    held = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            logits = [np.zeros((0, len(model.languages))), *model.logits(batch.column(1))]
            p = model.probabilities(np.concatenate(logits))
            told = batch.column(2).to_numpy(zero_copy_only=False)
            best = np.where(told, p.argmax(1), len(model.languages))
            score = np.where(told, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(score),
                    pa.array(score < model.accepted_from),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(tell, "doc_id long, lang_pred string, score double, rejected boolean")
