"""Cluster vectors around centroids, with zone maps that leave most distances uncomputed.

Vectors become whole numbers, so that sums, means and distances are exact whatever the order in
which tasks add them. They are put in the order of a Hilbert curve and written as blocks, each
with the least and greatest value of every component. The distances of that box to a centroid
bound those of all its vectors: a centroid whose least distance is beyond another's greatest is
none of theirs. A block with one candidate left is assigned whole, by the sum that is stored with
it; the others compare their vectors with the candidates only. Bounds are exact and keep ties, so
no result depends on the blocks.

Each round sends the centroids to the tasks and gets one sum for each cluster and component back.

Defined results: vectors that are null, have another number of components or a null or non-finite
one take no part, nor those with a component beyond ``LARGEST`` after scaling, whose squared
distances would not fit 64 bits. A vector without an id takes part but is no first centroid.
Repeated rows each count. Of centroids at equal distance the one with the smaller number is taken;
of first centroids with one id, the smaller components come first. With fewer vectors than
centroids there are as many centroids as vectors with an id; without any there are no rows. An
empty cluster keeps its centroid. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.stages import staged

#: Vectors of a block, and bits of the curve for each component.
BLOCK, BITS = 256, 4
LARGEST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The place of each row of ``cells`` (numbers below 2 ** bits) along a Hilbert curve.

    From the highest bit on, each axis turns or mirrors the finer bits of the first one, then
    the bits of all axes are Gray coded together. Comparing keys byte by byte compares places.
    """
    axes = cells.T.astype(np.int64).copy()
    for bit in reversed(range(1, bits)):
        high, low = 1 << bit, (1 << bit) - 1
        for axis in axes:
            mirror = (axis & high) > 0
            moved = np.where(mirror, low, (axes[0] ^ axis) & low)
            axes[0] ^= moved
            if axis is not axes[0]:
                axis ^= np.where(mirror, 0, moved)
    axes = np.bitwise_xor.accumulate(axes, axis=0)
    last, carried = axes[-1].copy(), np.zeros(axes.shape[1], np.int64)
    for bit in reversed(range(1, bits)):
        carried ^= np.where(last >> bit & 1, (1 << bit) - 1, 0)
    axes ^= carried
    spread = (axes[None] >> np.arange(bits)[::-1, None, None]) & 1
    packed = np.packbits(spread.reshape(-1, axes.shape[1]).astype(bool), axis=0)
    return [row.tobytes() for row in np.ascontiguousarray(packed.T)]


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids (columns) may be nearest to some vector of each box (row)."""
    low, high, at = low[:, None, :], high[:, None, :], centroids[None, :, :]
    outside = np.maximum(np.maximum(low - at, at - high), 0)
    across = np.maximum(np.abs(at - low), np.abs(high - at))
    least, most = (outside * outside).sum(2), (across * across).sum(2)
    return least <= most.min(1, keepdims=True)


def nearest_of(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the numbered centroids to each row of ``x``, and its squared distance."""
    away = x[:, None, :] - centroids[numbers][None]
    distance = (away * away).sum(2)
    best = distance.argmin(1)
    return numbers[best], distance[np.arange(len(x)), best]


def whole_numbers(vectors: DataFrame, column: str, dims: int, scale: int) -> DataFrame:
    """vec_id and the scaled components ``x`` of the vectors that take part."""
    number = F.col(column).cast("array<double>")
    finite = F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < LARGEST))
    return (
        vectors.where((F.size(column) == dims) & finite)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform(number, lambda v: F.floor(v * scale).cast("int")).alias("x"),
        )
    )


def first_centroids(numbers: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the ``k`` smallest digests."""
    digest: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = numbers.where("vec_id is not null").orderBy(digest, "x").select("x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def blocks_of(numbers: DataFrame, dims: int) -> DataFrame:
    """Written blocks of vectors that follow each other on the curve.

    Ranges of the curve are dealt to tasks. Where very many vectors are equal, a digest of their
    ids goes on with the order, so that a range may cut through them.
    """
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    mean, square = numbers.agg(F.avg(total) / dims, F.avg(squares) / dims).first()
    middle = mean or 0.0
    width = max(1.0, 6 * float(np.sqrt(max(0.0, (square or 0.0) - middle * middle))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dims)
            cells = np.clip(((x - middle) / width + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
            keys = pa.array(hilbert_keys(cells.astype(np.int64)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], ["vec_id", "x", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            x = batch.column(1).flatten().to_numpy().reshape(-1, dims).astype(np.int32)
            starts = range(0, len(x), BLOCK)
            parts = [x[s : s + BLOCK] for s in starts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(p) for p in parts], pa.int32()),
                    pa.array([ids[s : s + BLOCK].to_pylist() for s in starts], pa.list_(pa.int64())),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                    pa.array([p.min(0).tobytes() for p in parts], pa.binary()),
                    pa.array([p.max(0).tobytes() for p in parts], pa.binary()),
                    pa.array([p.sum(0, dtype=np.int64).tobytes() for p in parts], pa.binary()),
                ],
                ["n", "ids", "x", "low", "high", "total"],
            )

    placed = numbers.mapInArrow(place, "vec_id long, x array<int>, place binary")
    order = ["place", F.xxhash64("vec_id")]
    return staged(
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("vec_id", "x")
        .mapInArrow(
            cut,
            "n int, ids array<long>, x binary, low binary, high binary, total binary",
        ),
        "blocks",
    )


def _matrix(column: pa.Array, kind: type, dims: int) -> np.ndarray:
    rows = [np.frombuffer(b, kind) for b in column.to_pylist()]
    return np.array(rows, np.int64).reshape(len(rows), dims)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of each cluster and the sum of their components."""
    k, dims = centroids.shape
    held = blocks.sparkSession.sparkContext.broadcast(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            near = candidates(
                _matrix(batch.column(2), np.int32, dims), _matrix(batch.column(3), np.int32, dims), held.value
            )
            totals = _matrix(batch.column(4), np.int64, dims)
            for row, n in enumerate(batch.column(0).to_pylist()):
                numbers = np.flatnonzero(near[row])
                if len(numbers) == 1:
                    counts[numbers[0]] += n
                    sums[numbers[0]] += totals[row]
                    continue
                x = np.frombuffer(batch.column(1)[row].as_py(), np.int32).reshape(n, dims).astype(np.int64)
                cluster, _ = nearest_of(x, held.value, numbers)
                counts += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, x)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(k), dims), pa.int32()),
                pa.array(np.tile(np.arange(dims), k), pa.int32()),
                pa.array(np.repeat(counts, dims)),
                pa.array(sums.ravel()),
            ],
            ["cluster", "dim", "n", "total"],
        )

    found = (
        blocks.select("n", "x", "low", "high", "total")
        .mapInArrow(add, "cluster int, dim int, n long, total long")
        .groupBy("cluster", "dim")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .collect()
    )
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for r in found:
        counts[r.cluster] = r.n
        sums[r.cluster, r.dim] = r.total
    return counts, sums


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""
    dims = centroids.shape[1]
    held = blocks.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = candidates(
                _matrix(batch.column(2), np.int32, dims), _matrix(batch.column(3), np.int32, dims), held.value
            )
            for row in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[row].as_py(), np.int32).reshape(-1, dims)
                cluster, distance = nearest_of(
                    x.astype(np.int64), held.value, np.flatnonzero(near[row])
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row].values, pa.array(cluster, pa.int32()), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )

    return blocks.select("ids", "x", "low", "high").mapInArrow(
        assign, "vec_id long, cluster int, distance long"
    )


@dataclass
class Clustering:
    """vec_id, cluster and distance of each vector, and the centroids they were assigned to."""

    vectors: DataFrame
    centroids: np.ndarray


def cluster(
    vectors: DataFrame,
    column: str = "embedding",
    *,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
) -> Clustering:
    numbers = whole_numbers(vectors, column, dims, scale)
    centroids = first_centroids(numbers, k, seed)
    if not len(centroids):
        none = numbers.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(none.where("false"), centroids)
    blocks = blocks_of(numbers, dims)
    for _ in range(rounds):
        counts, sums = _sums(blocks, centroids)
        filled = counts > 0
        centroids[filled] = sums[filled] // counts[filled, None]
    return Clustering(staged(_assigned(blocks, centroids), "assigned"), centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """Each vector with the sums of distances of its cluster and of all, and its centroid's digest.

    What is broadcast has one row for each centroid.
    """
    sums = {r.cluster: r.inertia for r in found.vectors.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    whole = sum(sums.values())
    about = [
        (c, sums.get(c, 0), whole, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
        for c, x in enumerate(found.centroids.tolist())
    ]
    each = found.vectors.sparkSession.createDataFrame(
        about, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.vectors.join(F.broadcast(each), F.col("cluster") == F.col("_cluster")).drop("_cluster")
