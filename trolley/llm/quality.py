"""Judge documents by their words and by the sites they come from.

A logistic model over hashed words gives the evidence of a document: how much more likely its
words are in a good document than in a bad one. The prior comes from labelled documents of the
same site by hierarchical empirical Bayes: the share of good ones under a path shrinks towards
its host's, and that towards all documents', by as many documents as the spread between the
sites justifies. Evidence and prior add up as log odds.

The model is fitted on at most ``FIT_DOCUMENTS`` labelled documents, drawn by a hash of their
ids, with at most ``FIT_BUCKETS`` distinct hashed words each. Counts of hosts and paths are taken over all labelled documents.

Defined results: a null text counts as empty, and an empty one has no evidence. A document
without a url has its source as host and no path; a null source is a host too. Labels that are
null do not count; of several for one id the lowest counts. Without both kinds of labels there
is no evidence, and without any the prior is even, so that all documents are kept. Repeated
rows each get their judgement. An empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.hashing import LOWER, WordHasher, mixed, text_chunks, word_bounds
from trolley.llm.stages import staged
from trolley.llm.url_filters import url_parts

FIT_DOCUMENTS = 20_000
#: Texts with more distinct buckets are not drawn, so that the sample is bounded in bytes: 320 MB.
FIT_BUCKETS = 4096
BUCKETS = 1 << 18
PASSES = 6
#: Bounds of the number of documents that a site's prior is worth.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0
KEEP_FROM = 0.5


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct buckets of each text's words and of their last bytes."""
    hasher = WordHasher()
    for first, last, data, offsets in text_chunks(texts):
        starts, ends, rows = word_bounds(data, offsets)
        words = hasher(LOWER[data], starts, ends)
        endings = mixed(data[ends - 1].astype(np.uint64) + np.uint64(1 << 40))
        both = (np.stack([words, endings], axis=1) % np.uint64(BUCKETS)).astype(np.int32)
        for row in range(last - first):
            yield np.unique(both[rows[row] : rows[row + 1]])


def fit(found: list[np.ndarray], good: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the bias of a logistic model, by adaptive gradient steps."""
    weights, squares, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(len(found)).tolist():
            at = found[i]
            scale = 1 / np.sqrt(max(1, len(at)))
            error = 1 / (1 + np.exp(-(weights[at].sum() * scale + bias))) - good[i]
            step = error * scale
            squares[at] += step * step
            weights[at] -= 0.3 * step / np.sqrt(squares[at])
            bias -= 0.05 * error
    return weights.astype(np.float32), bias


def fit_on(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model from a bounded sample of the labelled documents.

    What it says beyond the share of good documents in the sample is their evidence, so the
    bias is given less that share's log odds.
    """
    count = labels.count()
    share = min(1.0, 0.9 * FIT_DOCUMENTS / max(1, count))
    drawn = labels.where(
        F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)
    ).limit(FIT_DOCUMENTS)
    ids = drawn.withColumnsRenamed({"doc_id": "_id"})

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary()), batch.column(2)],
                ["doc_id", "buckets", "good"],
            )

    sample = (
        docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"])
        .select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], ids["good"])
        .mapInArrow(take, "doc_id long, buckets binary, good boolean")
        .where(F.octet_length("buckets") <= 4 * FIT_BUCKETS)
        .limit(FIT_DOCUMENTS)
        .toArrow()
        .sort_by([("doc_id", "ascending")])
    )
    good = sample["good"].to_numpy().astype(float)
    if not len(good) or good.min() == good.max():
        return np.zeros(BUCKETS, np.float32), 0.0
    found = [np.frombuffer(b.as_py(), np.int32) for b in sample["buckets"]]
    weights, bias = fit(found, good)
    return weights, float(bias - np.log(good.sum() / (len(good) - good.sum())))


def evidence(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, text_key, source and evidence of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            scores = [
                float(weights[at].sum()) / np.sqrt(len(at)) + bias if len(at) else 0.0
                for at in features(batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(scores, pa.float64())],
                ["doc_id", "text_key", "source", "evidence"],
            )

    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        text_key(docs).alias("text_key"),
        docs["source"].cast("string").alias("source"),
        docs["text"].cast("string").alias("text"),
    ).mapInArrow(score, "doc_id long, text_key string, source string, evidence double")


def text_key(docs: DataFrame) -> Column:
    return F.sha2(F.coalesce(docs["text"], F.lit("")), 256)


def _weight(sites: DataFrame, good: str, n: str, towards: str) -> float:
    """How many documents a site's prior is worth, by the method of moments.

    The spread of the sites' shares beyond what chance gives within sites is that of a beta
    distribution, whose two parameters sum to the weight.
    """
    p = F.col(towards)
    chance = p * (1 - p)
    moments = (
        sites.where(F.col(n) > 0)
        .agg(
            F.sum(F.pow(F.col(good) - F.col(n) * p, 2) / F.col(n)).alias("seen"),
            F.sum(chance).alias("chance"),
            F.sum(chance * F.col(n)).alias("within"),
        )
        .first()
    )
    if moments["seen"] is None or moments["within"] <= 0:
        return MOST_WEIGHT
    beyond = moments["seen"] - moments["chance"]
    spread = moments["within"] - moments["chance"]
    if beyond <= 0 or spread <= 0:
        return MOST_WEIGHT
    return float(min(MOST_WEIGHT, max(LEAST_WEIGHT, spread / beyond - 1)))


def site_priors(placed: DataFrame) -> DataFrame:
    """host, path and prior of each site, from rows of host, path and good (or null)."""
    paths = staged(
        placed.groupBy("host", "path").agg(
            F.count_if("good").alias("good"), F.count("good").alias("n")
        ),
        "paths",
    )
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    overall = (total["good"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    hosts = paths.groupBy(F.col("host").alias("_host")).agg(
        F.sum("good").alias("host_good"), F.sum("n").alias("host_n"), F.lit(overall).alias("all")
    )
    weight = _weight(hosts, "host_good", "host_n", "all")
    hosts = hosts.withColumn(
        "host_prior",
        (F.col("host_good") + weight * F.col("all")) / (F.col("host_n") + F.lit(weight)),
    )
    joined = staged(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))), "hosts")
    weight = _weight(joined, "good", "n", "host_prior")
    return joined.select(
        "host",
        "path",
        ((F.col("good") + weight * F.col("host_prior")) / (F.col("n") + F.lit(weight))).alias(
            "prior"
        ),
    )


def judge(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, host, path, evidence, prior, quality, keep.

    ``labels`` has doc_id and quality (1 good, 0 bad); ``pages`` has doc_id and url.
    """
    known = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).alias("good"))
    )
    rows = staged(evidence(docs, fit_on(docs, known)), "evidence")
    urls = (
        pages.where("doc_id is not null and url is not null")
        .groupBy("doc_id")
        .agg(F.min("url").alias("url"))
        if pages is not None
        else docs.sparkSession.createDataFrame([], "doc_id long, url string")
    )
    host, path = url_parts(F.col("url"))
    # Rows without an id have no label and no url; in a join they would all meet in one task.
    named = rows.where("doc_id is not null")
    nameless = rows.where("doc_id is null").select(
        "*", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("string").alias("url")
    )
    placed = staged(
        named.join(known, "doc_id", "left")
        .join(urls, "doc_id", "left")
        .unionByName(nameless)
        .select(
            *("doc_id", "text_key", "evidence", "good"),
            F.when(F.col("url").isNull(), F.col("source")).otherwise(host).alias("host"),
            F.when(F.col("url").isNull(), "")
            .otherwise(F.regexp_extract(path, "^/[^/]*/", 0))
            .alias("path"),
        ),
        "placed",
    )
    priors = site_priors(placed).withColumnsRenamed({"host": "_host", "path": "_path"})
    odds = F.col("evidence") + F.log(F.col("prior") / (1 - F.col("prior")))
    quality = 1 / (1 + F.exp(-odds))
    return placed.join(
        priors,
        F.col("host").eqNullSafe(F.col("_host")) & (F.col("path") == F.col("_path")),
    ).select(
        *("doc_id", "text_key", "host", "path", "evidence", "prior"),
        quality.alias("quality"),
        (quality >= KEEP_FROM).alias("keep"),
    )
