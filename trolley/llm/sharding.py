"""Pack indivisible groups of documents into shards by best-fit decreasing.

Groups are documents with equal texts. Within parts chosen by a hash, small groups are bundled,
largest first, up to a fixed fraction of a shard; larger groups stay alone. So the items to
pack are at most a few thousand whatever the corpus, and best-fit decreasing runs over them:
the largest item first, each into the shard with the least room that still suffices, which a
balanced tree of the shards by their room finds. For a fixed number of shards the least
capacity that suffices is searched by bisection.

Defined results: a null text has size 1, as the empty text has, and is a group of its own.
A group larger than an even share has a shard of its own and the others share the rest evenly.
Repeated rows count each. With fewer groups than shards some shards stay empty; an empty table
gives an empty result. Columns besides ``doc_id`` and ``text`` take no part.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.positions import running_start
from trolley.llm.stages import staged, text_bytes

SHARDS = 16
#: Groups are bundled in so many parts, up to this fraction of a shard: at most
#: ``PARTS + 2 * SHARDS * FINENESS`` items reach the driver.
PARTS = 1024
FINENESS = 256
SEED = 5


class Room:
    """A balanced search tree (AA tree) of the pairs (room, shard)."""

    __slots__ = ("pair", "left", "right", "level")

    def __init__(self, pair: tuple[int, int]) -> None:
        self.pair, self.left, self.right, self.level = pair, None, None, 1


def _balanced(node: Room) -> Room:
    if node.left and node.left.level == node.level:
        up, node.left = node.left, node.left.right
        up.right, node = node, up
    if node.right and node.right.right and node.right.right.level == node.level:
        up, node.right = node.right, node.right.left
        up.left, node = node, up
        node.level += 1
    return node


def insert(node: Room | None, pair: tuple[int, int]) -> Room:
    if node is None:
        return Room(pair)
    if pair < node.pair:
        node.left = insert(node.left, pair)
    else:
        node.right = insert(node.right, pair)
    return _balanced(node)


def remove(node: Room | None, pair: tuple[int, int]) -> Room | None:
    if node is None:
        return None
    if pair < node.pair:
        node.left = remove(node.left, pair)
    elif pair > node.pair:
        node.right = remove(node.right, pair)
    elif node.left is None:
        return node.right
    else:
        last = node.left
        while last.right:
            last = last.right
        node.pair = last.pair
        node.left = remove(node.left, last.pair)
    low = min(node.left.level if node.left else 0, node.right.level if node.right else 0) + 1
    if low < node.level:
        node.level = low
        if node.right and node.right.level > low:
            node.right.level = low
        node = _balanced(node)
        if node.right:
            node.right = _balanced(node.right)
            if node.right.right:
                node.right.right = _balanced(node.right.right)
        node = _balanced(node)
    return node


def tightest(node: Room | None, size: int) -> tuple[int, int] | None:
    """The pair with the least room of at least ``size``."""
    best = None
    while node:
        if node.pair >= (size, -1):
            best, node = node.pair, node.left
        else:
            node = node.right
    return best


def best_fit(sizes: Iterable[int], capacity: int) -> list[int]:
    """The shard of each size, in the order given, which is to be descending.

    A shard is opened where none has room, so their number is not fixed here.
    """
    rooms, shards, opened = None, [], 0
    for size in sizes:
        pair = tightest(rooms, size)
        if pair is None:
            pair = (max(capacity, size), opened)
            opened += 1
        else:
            rooms = remove(rooms, pair)
        rooms = insert(rooms, (pair[0] - size, pair[1]))
        shards.append(pair[1])
    return shards


def pack(sizes: list[int], shards: int) -> list[int]:
    """The shard of each of the descending ``sizes``, at near equal fill of ``shards``."""
    rest, alone = sum(sizes), 0
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) >= rest:
        rest -= sizes[alone]
        alone += 1
    others, left = sizes[alone:], shards - alone
    if not others:
        return list(range(alone))
    low = max(others[0], -(-rest // left))
    high = 2 * low
    while high - low > max(1, low // 20000):
        middle = (low + high) // 2
        if max(best_fit(others, middle)) < left:
            high = middle
        else:
            low = middle + 1
    packed = best_fit(others, low)
    if max(packed) >= left:
        packed = best_fit(others, high)
    return [*range(alone), *(alone + shard for shard in packed)]


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, group_size, shard, slot."""
    rows = staged(
        docs.select(
            "doc_id",
            (text_bytes() + 1).alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            F.coalesce(F.sha2("text", 256), F.lit("null")).alias("text_key"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "rows",
    )
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("group_size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundled = staged(_bundled(groups, max(1, total // (shards * FINENESS))), "bundled")
    items = (
        bundled.groupBy("part", "bundle")
        .agg(F.sum("group_size").alias("size"))
        .orderBy(F.desc("size"), "part", "bundle")
        .collect()
    )
    placed = docs.sparkSession.createDataFrame(
        [
            (item["part"], item["bundle"], shard)
            for item, shard in zip(items, pack([i["size"] for i in items], shards), strict=True)
        ],
        "part int, bundle long, shard int",
    )
    in_shard = staged(
        rows.join(
            bundled.join(F.broadcast(placed), ["part", "bundle"]).select(
                "text_key", "group_size", "shard"
            ),
            "text_key",
        ).withColumn("one", F.lit(1)),
        "in_shard",
    )
    return running_start(in_shard, "shard", "one", "row", SEED, into="slot").select(
        "doc_id", "size", "text_crc32", "group_size", "shard", "slot"
    )


def _bundled(groups: DataFrame, limit: int) -> DataFrame:
    part: Column = F.pmod(F.xxhash64("text_key"), F.lit(PARTS)).cast("int")
    before = (
        Window.partitionBy("part")
        .orderBy(F.desc("group_size"), "text_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return groups.withColumn("part", part).withColumn(
        "bundle",
        F.floor(F.coalesce(F.sum("group_size").over(before), F.lit(0)) / F.lit(limit)),
    )
