"""Join texts whose word five-grams have a Jaccard similarity of 0.8 or more.

A MinHash LSH forest finds candidates. Each tree has a label of a text, the minima of a row of
hash functions over its shingles; texts whose labels share a prefix meet in that node of the
tree's trie, which sorting by prefix lays out. A short prefix is enough for almost all texts:
at the first of ``LENGTHS`` a pair at the threshold meets in one of few trees with the target
probability. Where a node holds more than ``NODE`` texts, such as a template's, its texts go on to
the next longer prefix, and to as many more trees as keep that probability. So prefixes are long
only where texts crowd, and no node's work grows with the corpus.

In a node, texts are compared by the minima they have, loosely enough to lose no pair, and a
spanning forest of what agrees leaves the node. Connected components of those links are cut into
blocks; each pair of blocks is verified on the whole shingle sets by a matrix product, and what
leaves it is a count for each text and a spanning forest of the links, never the pairs
themselves. Texts that crowd in a node of the longest prefix are nearly equal: all are linked to
the smallest.

Defined results: rows with equal texts are one class, which counts once; a null text counts as
empty. A text under five words has one shingle, all of its words; one without words has no
links. Case and punctuation count. A class's id is its smallest doc_id, a group's id the
smallest of its classes'; null ids come last. Repeated rows are copies. An empty table gives an
empty result. Columns besides ``doc_id`` and ``text`` take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.components import components
from trolley.llm.filters import maybe_in
from trolley.llm.hashing import WordHasher, minhashes, mixed, shingles, text_chunks, word_bounds
from trolley.llm.stages import keep_rows, staged

SIZE = 5
THRESHOLD = 0.8
TREES = 20
#: Prefixes of a label that are tried, where the one before holds too many texts.
LENGTHS = (4, 8, 16)
RECALL = 0.9999
#: Texts of a node that are compared with each other; in nodes of up to ``FEW``, pair by pair.
NODE, FEW = 4096, 64
#: Levels of the first trees whose minima are kept, a byte of each, to compare texts; and how many
#: of those ``TREES * SKETCHED`` bytes agree in a pair at the threshold, but for one in 50,000.
SKETCHED, AGREE = 8, 106
#: Pairs that a task compares at once.
PAIRS = 1 << 16
#: Texts, and shingles, in a block.
BLOCK = 64
BLOCK_SHINGLES = 1 << 20
COLUMNS = 1 << 15


def trees_for(length: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Trees in one of which a pair at the threshold shares a prefix with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log1p(-(threshold**length)))


def signed(docs: DataFrame, length: int = LENGTHS[0], trees: int = TREES) -> DataFrame:
    """doc_id, text_key, the prefix in each tree and a sketch (none without words) of each row."""
    longest, levels = LENGTHS[-1], max(length, SKETCHED)
    functions = np.arange(trees)[:, None] * longest + np.arange(levels)[None, :]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(2)):
                starts, ends, rows = word_bounds(data, offsets)
                hashes, firsts = shingles(hasher(data, starts, ends), rows, SIZE)
                filled = np.diff(firsts) > 0
                prefixes, sketches = np.zeros((0, trees), np.uint64), []
                if len(hashes):
                    labels = minhashes(hashes, firsts, trees * longest, only=functions.ravel())
                    labels = labels.reshape(-1, trees, levels)
                    sketches = [
                        row.tobytes() for row in labels[:, :TREES, :SKETCHED].astype(np.uint8)
                    ]
                    prefixes = labels[:, :, 0]
                    for level in range(1, length):
                        prefixes = mixed(prefixes + labels[:, :, level])
                lists = np.concatenate([[0], np.cumsum(filled)]) * trees
                held = iter(sketches)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(1).slice(first, last - first),
                        pa.ListArray.from_arrays(
                            pa.array(lists.astype(np.int32)),
                            pa.array(prefixes.reshape(-1).view(np.int64)),
                        ),
                        pa.array([next(held) if some else None for some in filled], pa.binary()),
                    ],
                    ["doc_id", "text_key", "prefixes", "sketch"],
                )

    return keyed(docs).mapInArrow(
        sign, "doc_id long, text_key string, prefixes array<long>, sketch binary"
    )


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.sha2(text, 256).alias("text_key"),
        text.alias("text"),
    )


def agreeing(nodes: DataFrame, agree: int = AGREE) -> DataFrame:
    """``a`` and ``b``: a spanning forest of the texts of each node whose sketches agree.

    ``nodes`` has tree, prefix, class and sketch, with a bounded number of rows for each node.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            tree, prefix = (rows[n].to_numpy() for n in ("tree", "prefix"))
            # The last node may go on in the next batch.
            whole = int(np.flatnonzero((tree != tree[-1]) | (prefix != prefix[-1]))[-1:].sum() + 1)
            whole = whole if tree[0] != tree[-1] or prefix[0] != prefix[-1] else 0
            held = rows.slice(whole)
            if whole:
                yield _forest(rows.slice(0, whole), agree)
        if held is not None and held.num_rows:
            yield _forest(held, agree)

    return (
        nodes.select("tree", "prefix", "class", "sketch")
        .repartition("tree", "prefix")
        .sortWithinPartitions("tree", "prefix", "class")
        .mapInArrow(compare, "a long, b long")
    )


def _forest(rows: pa.Table, agree: int) -> pa.RecordBatch:
    """Each text of the sorted nodes with the smallest that it is linked to, directly or not."""
    tree, prefix, names = (rows[n].to_numpy() for n in ("tree", "prefix", "class"))
    sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(names), -1)
    edge = np.ones(len(names), bool)
    edge[1:] = (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])
    end = np.append(np.flatnonzero(edge)[1:], len(names))
    start = np.flatnonzero(edge)
    size = end - start
    # In small nodes every row with each that follows it, in pieces of about ``PAIRS`` pairs.
    after = np.repeat(end, size) - np.arange(len(names)) - 1
    after[np.repeat(size > FEW, size)] = 0
    upto = np.cumsum(after)
    one, other = [], []
    low = 0
    while low < len(names):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS)))
        count = after[low:high]
        i = np.repeat(np.arange(low, high), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        good = (sketches[i] == sketches[j]).sum(1) >= agree
        one.append(i[good])
        other.append(j[good])
        low = high
    i, j = np.concatenate(one), np.concatenate(other)
    root = np.arange(len(names))
    while True:
        least, now = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == root).all():
            break
        root = now
    for first, last in zip(start[size > FEW].tolist(), end[size > FEW].tolist()):
        root[first:last] = first + _linked(sketches[first:last], agree)
    linked = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays(
        [pa.array(names[linked]), pa.array(names[root[linked]])], ["a", "b"]
    )


def _linked(sketches: np.ndarray, agree: int) -> np.ndarray:
    """The first row that each row is linked to, directly or not.

    A row is compared with those that it is not yet linked to, so a crowd that agrees with its
    first row costs one pass.
    """
    root = np.arange(len(sketches))
    for row in range(len(sketches)):
        others = np.flatnonzero(root != root[row])
        if not len(others):
            break
        same = others[(sketches[others] == sketches[row]).sum(1) >= agree]
        if len(same):
            joined = np.unique(np.append(root[same], root[row]))
            root[np.isin(root, joined)] = joined[0]
    return root


def candidate_links(
    docs: DataFrame, classes: DataFrame, lengths: tuple[int, ...] = LENGTHS, node: int = NODE
) -> DataFrame:
    """``a`` and ``b``: links whose components hold all pairs that may be similar.

    What is known of the nodes is written before the join, so that adaptive execution can split it
    where a node has very many texts. Only the texts that meet others bring their sketches.
    """
    links: list[DataFrame] = []
    members = classes.select("class", "text_key", "prefixes", "sketch")
    for number, length in enumerate(lengths):
        placed = members.select("class", F.posexplode("prefixes").alias("tree", "prefix"))
        sizes = staged(
            placed.groupBy(F.col("tree").alias("_tree"), F.col("prefix").alias("_prefix"))
            .agg(F.min("class").alias("least"), F.count("*").alias("n"))
            .where("n > 1"),
            f"nodes{length}",
        )
        same = (F.col("tree") == F.col("_tree")) & (F.col("prefix") == F.col("_prefix"))
        met = staged(placed.join(sizes, same).select("class", "tree", "prefix", "least", "n"), f"met{length}")
        sketches = members.select(F.col("class").alias("_class"), "sketch")
        light = met.where(F.col("n") <= node).join(sketches, F.col("class") == F.col("_class"))
        links.append(agreeing(light))
        crowded = met.where(F.col("n") > node)
        if crowded.isEmpty():
            break
        if number + 1 == len(lengths):
            links.append(crowded.select(F.col("class").alias("a"), F.col("least").alias("b")))
            break
        longer = lengths[number + 1]
        going = staged(
            crowded.select("class")
            .distinct()
            .join(members.select("class", "text_key", "sketch"), "class"),
            f"crowded{length}",
        )
        texts = docs.select("doc_id", "text", _text_key(docs).alias("key"))
        some = maybe_in(texts, going.select(F.col("text_key").alias("key")), "key")
        again = (
            signed(some, longer, trees_for(longer))
            .groupBy("text_key")
            .agg(F.any_value("prefixes").alias("prefixes"))
        )
        members = staged(going.join(again, "text_key"), f"members{longer}")
    return reduce(DataFrame.unionByName, links)


def _text_key(docs: DataFrame) -> Column:
    return F.sha2(F.coalesce(docs["text"], F.lit("")), 256)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """The column ``text`` replaced by ``shingles``, its distinct hashes as packed uint64."""
    others = [c for c in texts.columns if c != "text"]
    fields = ", ".join(f"{name} {kind}" for name, kind in texts.dtypes if name != "text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column("text")):
                starts, ends, rows = word_bounds(data, offsets)
                hashes, firsts = shingles(hasher(data, starts, ends), rows, SIZE)
                sets = [
                    np.unique(hashes[i:j]).tobytes()
                    for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)
                ]
                columns = [batch.column(name).slice(first, last - first) for name in others]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(sets, pa.binary())], [*others, "shingles"]
                )

    return texts.mapInArrow(take, f"{fields}, shingles binary")


def in_block_pairs(members: DataFrame) -> DataFrame:
    """Each member of a component once for each pair of blocks that its block is in."""
    counts = F.greatest(
        F.ceil(F.count("*") / BLOCK),
        F.ceil(F.sum(F.octet_length("shingles")) / (8 * BLOCK_SHINGLES)),
    )
    blocks = staged(
        members.groupBy(F.col("root").alias("_root")).agg(counts.alias("_blocks")), "blocks"
    )
    own = F.pmod(F.xxhash64("class"), "_blocks").alias("block")
    return (
        members.join(blocks, F.col("root") == F.col("_root"))
        .select("root", "class", "class_size", "shingles", "_blocks", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .select(
            *("root", "class", "class_size", "shingles", "block"),
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
        )
    )


def verified(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each pair of blocks: class, its links and linked rows there, and a linked root."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(7)), strict=True):
                root, low, high = row[0].as_py(), row[5].as_py(), row[6].as_py()
                if (root, low, high) != key:
                    if len(held) > 1:
                        yield from _links(held, threshold)
                    key, held = (root, low, high), []
                held.append(
                    (
                        row[1].as_py(),
                        row[2].as_py(),
                        np.frombuffer(row[3].as_py(), np.uint64),
                        row[4].as_py() == low,
                    )
                )
        if len(held) > 1:
            yield from _links(held, threshold)

    return (
        pairs.repartition("root", "low", "high")
        .sortWithinPartitions("root", "low", "high", "class")
        .mapInArrow(verify, "class long, links long, linked_rows long, root long")
    )


def _links(held: list[tuple], threshold: float) -> Iterator[pa.RecordBatch]:
    names = np.array([row[0] for row in held])
    copies = np.array([row[1] for row in held])
    sizes = np.array([len(row[2]) for row in held])
    low = np.array([row[3] for row in held])
    owner = np.repeat(np.arange(len(held)), sizes)
    _, column, count = np.unique(
        np.concatenate([row[2] for row in held]), return_inverse=True, return_counts=True
    )
    shared = count > 1
    owner = owner[shared[column]]
    column = (np.cumsum(shared) - 1)[column[shared[column]]]
    both = np.zeros((len(held), len(held)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((len(held), COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        both += has @ has.T
    union = sizes[:, None] + sizes[None, :] - both.astype(np.float64)
    linked = both.astype(np.float64) / np.maximum(union, 1) >= threshold
    np.fill_diagonal(linked, False)
    if not low.all():
        linked &= low[:, None] != low[None, :]
    if not linked.any():
        return
    root = np.arange(len(held))
    while True:
        seen = np.where(linked, root[None, :], len(held)).min(axis=1)
        now = np.minimum(root, seen)
        now = now[now]
        if (now == root).all():
            break
        root = now
    some = linked.any(axis=1)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(names[some]),
            pa.array(linked.sum(axis=1)[some]),
            pa.array((linked @ copies)[some]),
            pa.array(names[root[some]]),
        ],
        ["class", "links", "linked_rows", "root"],
    )


def _grouped(docs: DataFrame) -> DataFrame:
    """As :func:`near_duplicates`, with each row's text_key and whether its text stands for the group."""
    rows = staged(signed(docs), "signed")
    classes = staged(
        rows.groupBy("text_key")
        .agg(
            F.min("doc_id").alias("class_id"),
            F.count("*").alias("class_size"),
            F.any_value("prefixes").alias("prefixes"),
            F.any_value("sketch").alias("sketch"),
        )
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    found = staged(components(candidate_links(docs, classes)), "candidates")
    named = staged(
        found.join(classes.drop("prefixes", "sketch"), F.col("node") == F.col("class")).select(
            "root", "class", "class_size", "text_key"
        ),
        "members",
    )
    texts = (
        maybe_in(keyed(docs).drop("doc_id"), named.select("text_key"), "text_key")
        .groupBy("text_key")
        .agg(F.any_value("text").alias("text"))
    )
    sets = staged(shingle_sets(named.join(texts, "text_key").drop("text_key")), "shingles")
    links = staged(verified(in_block_pairs(sets)), "links")
    groups = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy(F.col("class").alias("node")).agg(
        F.sum("links").alias("n_links"), F.sum("linked_rows").alias("n_linked_rows")
    )
    grouped = staged(
        classes.drop("prefixes", "sketch")
        .join(counted, F.col("class") == F.col("node"), "left")
        .drop("node")
        .join(groups, F.col("class") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "class"))
        .drop("node"),
        "grouped",
    )
    # Of texts with the group's smallest id the one with the smallest key stands for it.
    first = F.min(F.struct(F.col("class_id").isNull(), "class_id", "text_key"))
    smallest = staged(
        grouped.groupBy("root")
        .agg(first.alias("first"))
        .select("root", F.col("first.class_id").alias("group_id"), F.col("first.text_key").alias("group_key")),
        "smallest",
    )
    return (
        rows.select("doc_id", "text_key")
        .join(grouped.join(smallest, "root"), "text_key")
        .select(
            "doc_id",
            "class_id",
            "class_size",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("n_linked_rows", F.lit(0)).alias("n_linked_rows"),
            "group_id",
            "text_key",
            (F.col("text_key") == F.col("group_key")).alias("stands"),
        )
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``.

    doc_id, class_id and class_size (rows with its text), n_links (other texts that are
    similar), n_linked_rows (rows with those texts) and group_id (linked directly or through
    others).
    """
    return _grouped(docs).drop("text_key", "stands")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group the rows with its smallest doc_id and, of several texts, one of these."""
    chosen = _grouped(docs).where(
        F.col("stands") & F.col("doc_id").eqNullSafe(F.col("group_id"))
    )
    return keep_rows(docs, chosen.select("doc_id", "text_key"))
