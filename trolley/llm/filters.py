"""A membership filter of bounded size, to let most rows out before a join shuffles them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many bitmaps of 32,768 bits: 1 MB in all, whatever the data.
BITMAPS = 256
#: At most so many where they are sized by the members: 16 MB.
MOST_BITMAPS = 4096


def bitmaps_for(members: int) -> int:
    """Ten bits for each member, within bounds: about a tenth of the other rows pass."""
    return min(MOST_BITMAPS, max(BITMAPS, members * 10 // 32768 + 1))


def split_by_filter(
    df: DataFrame, members: DataFrame, key: str, bitmaps: int = BITMAPS
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` may be in ``members``, and those whose is not.

    The bits of the members' hashes are broadcast, up to ``MOST_BITMAPS`` bitmaps of 4 KB. Where
    there are more members than those can tell apart, more rows pass; an exact join has to follow.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(bitmaps * 32768))
    held = (
        members.select((bit / 32768).cast("int").alias("_map"), (bit % 32768).alias("_bit"))
        .groupBy("_map")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )
    byte = "conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10)"
    marked = (
        df.select("*", (bit / 32768).cast("int").alias("_map"), (bit % 32768).alias("_bit"))
        .join(F.broadcast(held), "_map", "left")
        .withColumn(
            "_maybe",
            F.coalesce(
                F.expr(f"shiftright(cast({byte} as int), cast(_bit % 8 as int)) % 2 = 1"), F.lit(False)
            ),
        )
    )
    columns = [F.col(f"`{c}`") for c in df.columns]
    return marked.where("_maybe").select(*columns), marked.where("not _maybe").select(*columns)


def maybe_in(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``members``, and some others.

    The bits of the members' hashes are broadcast: 1 MB, however many there are. The more
    members, the more other rows pass; an exact join has to follow.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(BITMAPS * 32768))
    bitmaps = (
        members.select((bit / 32768).cast("int").alias("_map"), (bit % 32768).alias("_bit"))
        .groupBy("_map")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )
    byte = "conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10)"
    return (
        df.select("*", (bit / 32768).cast("int").alias("_map"), (bit % 32768).alias("_bit"))
        .join(F.broadcast(bitmaps), "_map")
        .where(F.expr(f"shiftright(cast({byte} as int), cast(_bit % 8 as int)) % 2 = 1"))
        .select(*df.columns)
    )
