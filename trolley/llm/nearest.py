"""Nearest vectors by multi-index hashing.

Vectors are centred, rotated onto principal axes and rotated again so that their signs lose the
least (iterative quantisation), which gives binary codes. Codes are put in order and cut into
blocks. In a block, codes are cut into substrings of eight bits, and each substring has an index:
the rows of each of its 256 values. Two codes within a Hamming radius ``r`` agree up to ``r // m``
bits in one of ``m`` substrings, so looking up the values that near a query's own retrieves every
code of the block within the radius, and only those rows are ranked by their exact distances. The
radius is learned too: the least one that reaches the wanted recall for queries within the sample.

A directory says which values each block holds. Where codes have structure, a query's values lead
to few blocks, and only these get the query; where every block holds values near it, all do. Of
each block a query gets back no more than it can return.

The rotation and the radius come from a sample of ``FIT_ROWS`` vectors at most; every vector is
indexed and searched. Equal vectors are one, with the ``k + 1`` smallest of their ids and how often
each occurs, which is all that a query can return of them. Large buckets are cut into chunks, and every chunk is probed.
Queries whose vectors within the radius are fewer than ``k`` search again with a larger one, up
to that of all codes. No query or vector passes through the driver, but for the sample.

Defined results: vectors that are null, zero, of another length than most, that hold a null
or a non-finite number or that have no id take no part. A query does not find rows with its own
id. A query finds ``k`` rows, or all if there are fewer. Ties go to the smaller id. Repeated rows each
count, as queries once. An empty table gives an empty result. Columns besides ``vec_id``
and ``embedding`` take no part.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.stages import buckets_for, staged

FIT_ROWS = 20_000
#: Vectors of a block.
BLOCK = 8192
#: Queries whose values are written out at once.
QUERY_BLOCK = 512
RECALL = 0.97
ROUNDS = 40
BYTES_APART = np.array([bin(i).count("1") for i in range(256)], np.uint8)
APART = BYTES_APART[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


@dataclass
class Codes:
    """A learned rotation and the radius within which codes are retrieved."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    @property
    def bytes(self) -> int:
        return -(-len(self.mean) // 8)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1)


def learn_codes(sample: np.ndarray, k: int, recall: float = RECALL, seed: int = 3) -> Codes:
    """Principal axes, rotated until signs fit best, and the radius for ``recall``."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(sample.shape[1], sample.shape[1])))[0]
    projected = centred @ axes
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.sign(projected @ turn).T @ projected)
        turn = (left @ right).T
    codes = Codes(mean, axes @ turn, 8 * len(np.packbits(np.zeros(sample.shape[1], bool))))
    packed = codes.of(sample)
    asked = np.arange(0, len(sample), max(1, len(sample) // 200))
    far = []
    for q in asked.tolist():
        away = np.square(sample - sample[q]).sum(axis=1)
        away[q] = np.inf
        near = np.argsort(away)[: min(k, len(sample) - 1)]
        far.extend(BYTES_APART[packed[near] ^ packed[q]].sum(axis=1).tolist())
    if far:
        codes.radius = int(np.quantile(far, recall, method="higher"))
    return codes


def valid_vectors(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """vec_id and embedding, in double precision, of the vectors that take part.

    Those have ``length`` components, by default as many as most have.
    """
    numbers = F.col("embedding").cast("array<double>")
    good: Column = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))
    rows = rows.where(good & F.col("vec_id").isNotNull())
    if length is not None:
        return rows.where(F.size("embedding") == length)
    most = (
        rows.groupBy(F.size("embedding").alias("length"))
        .count()
        .orderBy(F.desc("count"), "length")
        .first()
    )
    return rows.where(F.size("embedding") == (most["length"] if most else 0))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if len(column) else width or 1)


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Binary values of ``width`` bytes as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def sample_of(valid: DataFrame) -> np.ndarray:
    share = min(1.0, 0.9 * FIT_ROWS / max(1, valid.count()))
    drawn = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1_000_000)) < int(1_000_000 * share)
    sample = _matrix(valid.where(drawn).select("embedding").limit(FIT_ROWS).toArrow()["embedding"])
    if len(sample) < 2:
        sample = _matrix(valid.select("embedding").limit(FIT_ROWS).toArrow()["embedding"])
    return sample


def coded_classes(valid: DataFrame, codes, k: int, name: str) -> DataFrame:
    """Distinct vectors with their codes and smallest ids, and how often each of these occurs.

    ``codes`` is broadcast. The ids of a vector that very many rows share are cut down in the
    tasks that count them, before they meet.
    """
    same = F.struct(F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")).alias("same")
    counted = valid.groupBy(same, "vec_id").agg(
        F.any_value("embedding").alias("embedding"), F.count("*").alias("times")
    )
    smallest = Window.partitionBy("same").orderBy("vec_id")
    few = (
        counted.withColumn("place", F.row_number().over(smallest))
        .where(F.col("place") <= k + 1)
        .groupBy("same")
        .agg(
            F.any_value("embedding").alias("embedding"),
            F.sort_array(F.collect_list(F.struct("vec_id", "times"))).alias("ids"),
        )
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = codes.value.of(_matrix(batch.column(1), len(codes.value.mean)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([row.tobytes() for row in found], pa.binary())],
                ["same", "embedding", "ids", "code"],
            )

    fields = ", ".join(f"{n} {kind}" for n, kind in few.dtypes)
    return staged(
        few.mapInArrow(code, f"{fields}, code binary").withColumn(
            "class", F.monotonically_increasing_id()
        ),
        name,
    )


def splits_of(sample_codes: np.ndarray, rows: int) -> list[bytes]:
    """Codes between which blocks of about ``BLOCK`` rows lie, from those of the sample."""
    ordered = sorted(set(map(bytes, sample_codes)))
    most = min(buckets_for(rows, BLOCK), len(ordered))
    return [ordered[i * len(ordered) // most] for i in range(1, most)]


def blocked(classes: DataFrame, splits) -> DataFrame:
    """``classes`` with the block of each code. ``splits`` is broadcast: at most ``FIT_ROWS`` codes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(splits.value, code) for code in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "block"]
            )

    fields = ", ".join(f"{n} {kind}" for n, kind in classes.dtypes)
    return classes.mapInArrow(place, f"{fields}, block int")


def directory(classes: DataFrame, parts: int) -> DataFrame:
    """part, value and block: which values the codes of each block have."""
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    value = F.conv(F.hex(F.substring("code", F.col("part") + 1, F.lit(1))), 16, 10).cast("int")
    return classes.select("block", "code", part).select("part", value.alias("value"), "block").distinct()


def probes(queries: DataFrame, parts: int, radius: int) -> DataFrame:
    """part, value and class of each value that a query's substrings are near to."""
    near = APART <= radius // parts
    each, counts = [np.flatnonzero(row).astype(np.int32) for row in near], near.sum(1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_BLOCK):
                some = batch.slice(start, QUERY_BLOCK)
                own = _bytes(some.column(1), parts)
                for part in range(parts):
                    row = np.repeat(np.arange(len(own)), counts[own[:, part]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), part, np.int32)),
                            pa.array(np.concatenate([each[v] for v in own[:, part].tolist()])),
                            some.column(0).take(pa.array(row)),
                        ],
                        ["part", "value", "class"],
                    )

    return queries.select("class", "code").mapInArrow(
        probe, "part int, value int, class long"
    )


def sent(asked: DataFrame, held: DataFrame, blocks: int, parts: int, radius: int) -> DataFrame:
    """``class`` of each query and the ``block`` it goes to.

    ``held`` is the directory. If of the values near a query a block is likely to hold one, all
    blocks are sent the query, which is what asking the directory would come to.
    """
    near = float((APART <= radius // parts).sum(1).mean())
    density = held.count() / (blocks * 256 * parts)
    if near * parts * density >= 1:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        return asked.select("class", every)
    return probes(asked, parts, radius).join(held, ["part", "value"]).select("class", "block").distinct()


class Index:
    """The rows of each value of each substring of a block's codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.rows = [np.argsort(codes[:, i], kind="stable") for i in range(codes.shape[1])]
        counts = [np.bincount(codes[:, i], minlength=256) for i in range(codes.shape[1])]
        self.first = [np.concatenate([[0], np.cumsum(c)]).tolist() for c in counts]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes are within ``radius`` of ``code``, from the buckets near it."""
        parts = len(code)
        found = []
        for part, own in enumerate(code.tolist()):
            first, rows = self.first[part], self.rows[part]
            values = np.flatnonzero(APART[own] <= radius // parts).tolist()
            found.extend(rows[first[v] : first[v + 1]] for v in values if first[v] < first[v + 1])
        if not found:
            return np.zeros(0, np.int64)
        rows = np.unique(np.concatenate(found))
        return rows[BYTES_APART[self.codes[rows] ^ code].sum(axis=1) <= radius]


def searched(
    classes: DataFrame, asked: DataFrame, places: DataFrame, parts: int, radius: int, k: int
) -> DataFrame:
    """query, class and score of the ``k + 1`` nearest classes of each query within the radius.

    ``places`` has the blocks that each query goes to. A large block is cut into chunks by a hash;
    the sizes that say so are as many as blocks, which are at most as many as the sample has rows.
    """
    sizes = classes.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    rows = classes.join(F.broadcast(sizes), "block").select(
        "block",
        F.pmod(F.xxhash64("class"), "chunks").alias("chunk"),
        *("class", "embedding", "code"),
        F.col("ids")[0]["vec_id"].alias("least"),
    )
    queries = (
        places.join(F.broadcast(sizes), "block")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .join(asked.select("class", "embedding", "code"), "class")
        .select("block", "chunk", "class", "embedding", "code")
    )

    def search(held: pa.Table, asking: pa.Table) -> pa.Table:
        names, least = held["class"].to_numpy(), held["least"].to_numpy()
        found: list[tuple] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        if held.num_rows and asking.num_rows:
            index, vectors = Index(_bytes(held["code"], parts)), _matrix(held["embedding"])
            codes, own = _bytes(asking["code"], parts), _matrix(asking["embedding"])
            for row, query in enumerate(asking["class"].to_pylist()):
                at = index.within(codes[row], radius)
                away = np.sqrt(np.square(vectors[at] - own[row]).sum(axis=1))
                best = np.lexsort((least[at], away))[: k + 1]
                at = at[best]
                found.append((np.full(len(at), query), names[at], least[at], away[best]))
        query, name, first, away = (np.concatenate(column) for column in zip(*found))
        return pa.table({"query": query, "class": name, "least": first, "score": away})

    few = Window.partitionBy("query").orderBy("score", "least")
    by = ["block", "chunk"]
    return (
        rows.groupBy(*by)
        .cogroup(queries.groupBy(*by))
        .applyInArrow(search, "query long, class long, least long, score double")
        .withColumn("place", F.row_number().over(few))
        .where(F.col("place") <= k + 1)
        .drop("place")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank from 1, vec_id and score, the distance, of what each query finds.

    ``queries`` has the columns of ``vectors``.
    """
    spark = vectors.sparkSession
    valid = valid_vectors(vectors)
    sample = sample_of(valid)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = learn_codes(sample, k)
    held = spark.sparkContext.broadcast(codes)
    parts, most, radius = codes.bytes, 8 * codes.bytes, codes.radius
    coded = coded_classes(valid, held, k, "coded")
    splits = splits_of(codes.of(sample), coded.count())
    classes = staged(blocked(coded, spark.sparkContext.broadcast(splits)), "classes")
    asked = coded_classes(valid_vectors(queries, sample.shape[1]), held, k, "queries")
    values = staged(directory(classes, parts), "directory")
    waiting, found = asked, []
    while not waiting.isEmpty():
        places = sent(waiting, values, len(splits) + 1, parts, radius)
        ranked = searched(classes, waiting, places, parts, radius, k)
        near = staged(_nearest_ids(ranked, classes, k), "near")
        if radius >= most:
            found.append(near)
            break
        enough = staged(
            near.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") > k).select("query"),
            "enough",
        )
        found.append(near.join(enough, "query", "left_semi"))
        waiting = staged(
            waiting.join(enough, F.col("class") == F.col("query"), "left_anti"), "waiting"
        )
        radius = min(most, radius + 2 * parts)
    members = valid_vectors(queries, sample.shape[1]).select(
        F.col("vec_id").alias("query_id"),
        F.struct(F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")).alias("same"),
    ).distinct()
    order = Window.partitionBy("query_id", "same").orderBy("score", "vec_id")
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return (
        reduce(DataFrame.unionByName, found)
        .join(asked.select(F.col("class").alias("query"), "same"), "query")
        .join(members, "same")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _nearest_ids(ranked: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """query, vec_id, times and score of the ``k + 1`` nearest ids of each query."""
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return (
        ranked.join(classes.select("class", F.explode("ids").alias("of")), "class")
        .select("query", "of.vec_id", "of.times", "score")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k + 1)
        .drop("place")
    )
