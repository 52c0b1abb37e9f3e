"""Running totals and top-n per key that survive a key holding a large share of all rows.

A window function sorts each key's rows in one task. For almost all keys that is fine. A hot
key is cut into blocks along the window's order instead: every block gets its own window, and
the totals of the earlier blocks, a short aggregate, are added to it. Blocks can be nested
(a day, and ranges of order ids within it), so that neither the rows of a block nor the blocks
of a key become many.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that a single task sorts without trouble; keys above it are cut into blocks.
HOT_ROWS = 1_000_000
# At most so many keys can be hot: those with a larger share of all rows than its inverse.
MOST_HOT_KEYS = 100_000


def hot_keys(df: DataFrame, key: str, max_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than ``max_rows`` rows in ``df``, and a share that stands out.

    A hot key also has more than 1 / ``MOST_HOT_KEYS`` of all rows, so there are fewer of them
    than that, however large ``df`` and small ``max_rows``. That bound is what allows
    broadcasting the list.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_rows"))
    least = counts.agg(F.sum("_rows") / MOST_HOT_KEYS).scalar()
    return counts.where(
        (F.col("_rows") > max_rows) & (F.col("_rows") > F.coalesce(least, F.lit(0.0)))
    ).select(F.col(key).alias("_hot_key"), F.lit(True).alias("_hot"))


def mark_hot(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``df`` with a column ``_hot``, true for the rows of the listed keys and otherwise NULL.

    Rows are best marked before ``df`` is joined to anything: the marked ones are needed on
    their own as well, and a filter on the mark moves down to here.
    """
    same = F.col(key).eqNullSafe(F.col("_hot_key"))
    return df.join(F.broadcast(hot), same, "left").drop("_hot_key")


def running_totals(
    marked: DataFrame,
    *,
    key: str,
    order_by: Sequence[str],
    totals: Mapping[str, Column],
    blocks: Sequence[Column],
    peers: bool = False,
    previous: Mapping[str, Column] | None = None,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add running sums of ``totals`` per ``key`` along ``order_by``.

    The frame runs from the key's first row to the current row (ROWS). With ``peers`` it also
    takes in the rows that tie with the current one (RANGE, the SQL default): a hot key's tied
    rows are summed first, the sums run over those, and every row takes what its ties have.

    ``marked`` comes from :func:`mark_hot`; the mark is dropped. ``key`` is an integer or a
    string. ``blocks`` cuts a hot key's rows, from coarse to fine; a finer cut applies only
    within blocks of more than ``max_rows`` rows. Sorting by the blocks must agree with
    ``order_by``. ``previous`` adds columns holding an expression's value in the row before;
    such an expression must not decrease along ``order_by``.
    """
    previous = previous or {}
    if peers:
        return _with_ties(marked, key, order_by, totals, blocks, max_rows)
    # Key and blocks as columns that are never NULL (a struct of NULL is not NULL): plain
    # equality then finds them, and the join below keeps the window's shuffle and sort.
    some_key = F.lit(0).cast(marked.schema[key].dataType)
    at = ["_key", "_no_key", *[f"_block{i}" for i in range(len(blocks))]]
    cut = marked.select(
        "*",
        F.coalesce(F.col(key), some_key).alias("_key"),
        F.col(key).isNull().alias("_no_key"),
    )
    for depth, block in enumerate(blocks, 2):
        cut = _cut(cut, at[:depth], at[depth], block, max_rows)

    along = Window.partitionBy(*at).orderBy(*order_by)
    frame = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = cut.select(
        "*",
        *[F.sum(e).over(frame).alias(name) for name, e in totals.items()],
        *[F.lag(e).over(along).alias(name) for name, e in previous.items()],
    )

    # Hot keys only: one row per block, then what the blocks before it add up to. Without hot
    # keys this side is empty, and adaptive execution drops it and the join below unrun.
    per_block = (
        cut.where("_hot")
        .groupBy(*at)
        .agg(
            *[F.sum(e).alias(name) for name, e in totals.items()],
            *[F.max(e).alias(name) for name, e in previous.items()],
        )
    )
    before = _before_block(per_block, at, list(totals), list(previous))
    return _join_before(within, before, at, "left").select(
        *[c for c in marked.columns if c != "_hot"],
        *[_add(F.col(n), F.col(f"_before_{n}")).alias(n) for n in totals],
        *[F.coalesce(F.col(n), F.col(f"_before_{n}")).alias(n) for n in previous],
    )


def _cut(
    df: DataFrame, around: list[str], name: str, block: Column, max_rows: int
) -> DataFrame:
    """Add the column ``name``: the block of a hot key's rows, or of a block that is too large.

    There are at most (rows / ``max_rows``) such blocks, and only hot keys have any.
    """
    if len(around) == 2:
        return df.withColumn(name, F.struct(F.when(F.col("_hot"), block).alias("at")))
    large = (
        df.where("_hot")
        .groupBy(*[F.col(c).alias(f"_large_{c}") for c in around])
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > max_rows)
        .drop("_rows")
        .withColumn("_large", F.lit(True))
    )
    same = [F.col(c) == F.col(f"_large_{c}") for c in around]
    return (
        df.join(F.broadcast(large), same, "left")
        .withColumn(name, F.struct(F.when(F.col("_large"), block).alias("at")))
        .drop("_large", *[f"_large_{c}" for c in around])
    )


def _with_ties(
    marked: DataFrame,
    key: str,
    order_by: Sequence[str],
    totals: Mapping[str, Column],
    blocks: Sequence[Column],
    max_rows: int,
) -> DataFrame:
    """Running sums where tied rows share theirs: a plain window, but for hot keys.

    However many rows of a hot key tie, the windows see one row for each key and place in the
    order. The join back is one of rows with those, which adaptive execution can split. Without
    hot keys it drops their branch before it runs.
    """
    place = [key, *order_by]
    columns = [c for c in marked.columns if c != "_hot"]
    with_peers = Window.partitionBy(key).orderBy(*order_by)
    others = marked.where(F.col("_hot").isNull()).select(
        *columns, *[F.sum(e).over(with_peers).alias(n) for n, e in totals.items()]
    )
    hot = marked.where("_hot")
    ties = hot.groupBy(*place, "_hot").agg(*[F.sum(e).alias(n) for n, e in totals.items()])
    running = running_totals(
        ties,
        key=key,
        order_by=order_by,
        totals={f"_run_{n}": F.col(n) for n in totals},
        blocks=blocks,
        max_rows=max_rows,
    ).select(
        *[F.col(c).alias(f"_tied_{c}") for c in place],
        *[F.col(f"_run_{n}").alias(n) for n in totals],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_tied_{c}")) for c in place]
    return others.unionByName(hot.join(running, same).select(*columns, *totals))


def _before_block(
    per_block: DataFrame, at: list[str], sums: list[str], maxima: list[str]
) -> DataFrame:
    """For each block, ``sums`` and ``maxima`` over the key's earlier blocks, as ``_before_*``.

    Blocks are compared within the block around them; the blocks before that one are added.
    """
    *around, block = at
    earlier = (
        Window.partitionBy(*around)
        .orderBy(block)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    before = per_block.select(
        *at,
        *[F.sum(n).over(earlier).alias(n) for n in sums],
        *[F.max(n).over(earlier).alias(n) for n in maxima],
    )
    if "_block0" in around:
        totals = per_block.groupBy(*around).agg(
            *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxima]
        )
        outside = _before_block(totals, around, sums, maxima)
        before = _join_before(before, outside, around, "inner").select(
            *at,
            *[_add(F.col(n), F.col(f"_before_{n}")).alias(n) for n in sums],
            *[F.coalesce(F.col(n), F.col(f"_before_{n}")).alias(n) for n in maxima],
        )
    return before.select([F.col(c).alias(f"_before_{c}") for c in before.columns])


def _join_before(df: DataFrame, before: DataFrame, at: list[str], how: str) -> DataFrame:
    """Neither key nor blocks are NULL, so plain equality does."""
    return df.join(before, [F.col(c) == F.col(f"_before_{c}") for c in at], how)


def _add(a: Column, b: Column) -> Column:
    """SUM's addition: NULL counts as nothing, and only two NULLs give NULL."""
    return F.coalesce(a + b, a, b)


def top_n(
    df: DataFrame, by: str, order: Sequence[Column], n: int, ties: bool, rank_column: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each ``by`` group in ``order``.

    ``ties`` keeps every row that ties with the n-th (RANK); otherwise exactly n remain
    (ROW_NUMBER), for which ``order`` should be a total order. The filter on the rank makes
    Spark drop the losers in every map task already (WindowGroupLimit), so only about n rows
    per task and group are shuffled, however large the group. Rows that tie within the first n
    all belong to the result of RANK, and meet in their group's task.
    """
    place = F.rank() if ties else F.row_number()
    within = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(rank_column, place.over(within)).where(F.col(rank_column) <= n)
