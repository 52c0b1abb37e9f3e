"""Clustering against plain loops, and the bounds of its blocks."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from trolley.llm import clusters
from trolley.llm.clusters import candidates, cluster, hilbert_keys, nearest_of, with_inertia

VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, x STRING, cluster STRING, place STRING, n INT"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "c", "p", 1) for i, v in rows], VECTORS)


def brute_force(rows, k=8, rounds=10):
    kept = [
        (i, [math.floor(1024 * float(np.float32(c))) for c in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)
    ]
    first = sorted(
        (hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None
    )
    centroids = [v for _, v in first[:k]]
    if not centroids:
        return []

    def assigned():
        return [
            min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
            for _, v in kept
        ]

    for _ in range(rounds):
        near = [n for _, n in assigned()]
        for n in set(near):
            own = [v for (_, v), m in zip(kept, near) if m == n]
            centroids[n] = [sum(column) // len(own) for column in zip(*own)]
    near, inertia = assigned(), Counter()
    for distance, n in near:
        inertia[n] += distance
    return [
        (
            *(i, n, distance, inertia[n], sum(inertia.values())),
            hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest(),
        )
        for (i, _), (distance, n) in zip(kept, near)
    ]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def made(n, seed=1, groups=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, 64))
    return [(i, (middles[i % groups] + 0.2 * rng.normal(size=64)).tolist()) for i in range(n)]


def test_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 7)
    good = made(150)
    same = good[3][1]
    awkward = [
        *((200 + i, same) for i in range(40)),
        (3, same),
        (3, same),
        (None, good[8][1]),
        (300, None),
        (301, []),
        (302, [1.0] * 63),
        (303, [1.0] * 63 + [None]),
        (304, [math.nan] + [1.0] * 63),
        (305, [math.inf] + [1.0] * 63),
        (306, [0.0] * 64),
        (307, [-0.0004] * 64),
        (308, [500.0, -500.0] * 32),
    ]
    rows = good + awkward
    found = with_inertia(cluster(frame(spark, rows).repartition(4)))
    assert rows_of(found) == Counter(brute_force(rows))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = made(n) + [(None, [0.5] * 64), (99, None)]
    assert rows_of(with_inertia(cluster(frame(spark, rows)))) == Counter(brute_force(rows))


def test_vectors_too_large_for_exact_distances_take_no_part(spark):
    rows = [*made(20), (500, [1e20] * 64)]
    assert rows_of(with_inertia(cluster(frame(spark, rows)))) == Counter(brute_force(rows[:-1]))


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(30)]
    assert rows_of(with_inertia(cluster(frame(spark, rows)))) == Counter(brute_force(rows))


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
    keys = hilbert_keys(grid, bits)
    assert len(set(keys)) == len(grid)
    along = grid[sorted(range(len(keys)), key=keys.__getitem__)]
    assert set(np.abs(np.diff(along, axis=0)).sum(1)) == {1}


def test_bounds_keep_the_nearest_and_drop_the_far():
    rng = np.random.default_rng(3)
    middles = rng.integers(-3000, 3000, (8, 64))
    x = (middles[rng.integers(0, 8, 4000)] + rng.integers(-200, 200, (4000, 64))).astype(np.int64)
    cells = np.clip(((x - x.mean()) / (6 * x.std()) + 0.5) * 16, 0, 15).astype(int)
    keys = hilbert_keys(cells)
    x = x[sorted(range(len(x)), key=keys.__getitem__)]
    blocks = x.reshape(-1, 40, 64)
    near = candidates(blocks.min(1), blocks.max(1), middles)
    best, _ = nearest_of(x, middles, np.arange(8))
    assert all(near[i, c] for i, own in enumerate(best.reshape(-1, 40)) for c in own)
    assert near.sum(1).mean() < 2
