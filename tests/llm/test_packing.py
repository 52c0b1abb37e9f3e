"""Sharding and mixing."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import EDGES, frame
from trolley.llm import mixing, sharding
from trolley.llm.positions import running_start


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(60, 150))
def test_best_fit(sizes, capacity):
    sizes.sort(reverse=True)
    room, expected = [], []
    for size in sizes:
        fits = sorted((r, i) for i, r in enumerate(room) if r >= size)
        if not fits:
            room.append(capacity)
            fits = [(capacity, len(room) - 1)]
        shard = fits[0][1]
        room[shard] -= size
        expected.append(shard)
    assert sharding.best_fit(sizes, capacity) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 99)), unique=True), st.integers(0, 9))
def test_balanced_tree(pairs, size):
    def height(node):
        return 1 + max(height(node.left), height(node.right)) if node else 0

    tree, held = None, set()
    for n, pair in enumerate(pairs):
        tree = sharding.insert(tree, pair)
        held.add(pair)
        if n % 3 == 2:
            gone = pairs[n // 2]
            if gone in held:
                tree = sharding.remove(tree, gone)
                held.discard(gone)
        assert sharding.tightest(tree, size) == min((p for p in held if p[0] >= size), default=None)
    assert height(tree) <= 2 * (len(held) + 1).bit_length()


def test_pack_is_even_around_a_large_group():
    rng = random.Random(2)
    sizes = sorted([rng.randint(1, 500) for _ in range(2000)] + [200_000], reverse=True)
    fill = Counter()
    for size, shard in zip(sizes, sharding.pack(sizes, 16), strict=True):
        fill[shard] += size
    assert fill.pop(0) == 200_000 and len(fill) == 15
    assert max(fill.values()) - min(fill.values()) < 600
    assert sharding.pack([], 16) == [] and sharding.pack([5, 5], 16) == [0, 1]


@pytest.mark.parametrize("more", [0, 3000])
def test_shard_documents(spark, nothing, more):
    rng = random.Random(3)
    rows = EDGES + [(100 + i, "y" * rng.randint(0, 40)) for i in range(more)]
    found = sharding.shard_documents(frame(spark, rows)).collect()
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == sizes
    of, slots = defaultdict(set), defaultdict(list)
    for r in found:
        of[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(shards) == 1 for k, shards in of.items() if k != (1, 0))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(16))
    assert sharding.shard_documents(nothing).count() == 0


def targets_by_hand(sizes):
    """Weights dealt again and again until no source is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in free}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_words_taken(spark, nothing):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice([*"aaaaabcdef", None])) for i in range(800)]
    rows += [(i, t, "b") for i, t in EDGES]
    sizes, words = Counter(), Counter()
    for i, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        words[i, n] += 1
    found = mixing.words_taken(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.size) for r in found) == words
    target, taken = targets_by_hand(sizes), Counter()
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source, words in taken.items():
        assert abs(words - target[source]) <= 1
    again = mixing.words_taken(frame(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.words_taken(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0


def test_schedule_spreads_sources(spark):
    rows = [(i, "w " * 50, s) for i, s in enumerate("abc" * 200)]
    targets = mixing.source_targets(mixing.sized_documents(frame(spark, rows)))
    plan = mixing.schedule(targets, slots=900).orderBy("slot").collect()
    blocks = Counter(r.source for r in plan)
    half = Counter(r.source for r in plan[: len(plan) // 2])
    for source, n in blocks.items():
        assert abs(half[source] - n / 2) <= 4
        assert sorted(r["rank"] for r in plan if r.source == source) == list(range(n))


def test_pieces_are_the_blocks_of_the_schedule(spark):
    """Each slot has the words of one block, of the source that the golden ratio's point names."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice("aaabc")) for i in range(400)]
    pieces = [r for r in mixing.mix(frame(spark, rows), slots=300).collect() if r.slot is not None]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    needs = {s: round(t) for s, t in targets_by_hand(sizes).items()}
    words = -(-sum(needs.values()) // 300)
    blocks = {s: -(-n // words) for s, n in needs.items()}
    total, upto, slots = sum(blocks.values()), 0, defaultdict(list)
    for s in sorted(blocks):
        low, upto = upto, upto + blocks[s]
        points = (((n + 0.5) * mixing.GOLDEN) % 1.0 * total for n in range(4 * total))
        slots[s] = [n for n, x in enumerate(points) if low <= x < upto][: blocks[s]]
    of, found = {}, defaultdict(int)
    for r in pieces:
        assert of.setdefault(r.slot, r.source) == r.source
        found[r.slot] += r.to_word - r.from_word
        assert 0 <= r.from_word < r.to_word <= r.size
    for s, n in needs.items():
        own = sorted(slot for slot, source in of.items() if source == s)
        assert own == slots[s]
        assert [found[x] for x in own[:-1]] == [words] * (len(own) - 1)
        assert found[own[-1]] == n - words * (len(own) - 1)


def test_another_sequence_gives_other_slots(spark):
    rows = [(i, "w " * 9, s) for i, s in enumerate("abc" * 60)]
    one, two = (
        {r.doc_id: (r.taken, r.first_slot) for r in mixing.words_taken(frame(spark, rows), golden=g).collect()}
        for g in (mixing.GOLDEN, 0.0001)
    )
    assert [t for t, _ in one.values()] != [] and one != two


def test_mixed_documents_follow_the_slots(spark):
    rows = [(i, f"word{i} " * 20, s) for i, s in enumerate("ab" * 100)]
    docs = frame(spark, rows).coalesce(1)
    order = [r.source for r in mixing.mixed_documents(docs).collect()]
    share = order.count("a") / len(order)
    for n in (30, 60, 120, len(order)):
        assert abs(order[:n].count("a") - share * n) <= 3


def test_rows_that_share_an_id_have_their_own_places(spark):
    rows = [(i % 40, f"t{i} " * (1 + i % 7), s) for i, s in enumerate("ab" * 60)] + [(5, "same text", "a")] * 9
    docs = frame(spark, rows).coalesce(1)
    found = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(docs).collect())
    given = Counter((i, t, s) for i, t, s in rows)
    assert all(n <= 2 * given[k] for k, n in found.items())
    words, sizes = Counter(), Counter()
    for (_, t, s), n in found.items():
        words[s] += n * len(t.split())
    for _, t, s in rows:
        sizes[s] += len(t.split())
    for s, target in targets_by_hand(sizes).items():
        assert abs(words[s] - target) <= 14


def test_mixed_documents_keep_their_columns(spark):
    rows = [(i, "w " * 20, s) for i, s in enumerate("ab" * 30)]
    docs = frame(spark, rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2 and abs(sum(copies.values()) - 90) <= 2


def test_running_start_of_a_hot_and_a_null_key(spark):
    rows = [(i, None if i % 7 == 0 else "hot" if i % 2 else f"k{i % 5}", i % 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "row LONG, k STRING, n INT")
    found = running_start(df, "k", "n", "row", 1, rows_per_bucket=20).collect()
    assert len(found) == 3000
    by_key = defaultdict(list)
    for r in found:
        by_key[r.k].append((r.start, r.start + r.n))
    for spans in by_key.values():
        spans.sort()
        assert spans[0][0] == 0
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
