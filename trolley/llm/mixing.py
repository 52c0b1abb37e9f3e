"""Mix sources to target weights along a low-discrepancy schedule.

Each source's documents, shuffled by a hash, form a stream of words that is cut into blocks of
equal length. The points of a golden-ratio sequence, mapped through the cumulative weights of
the sources, say whose block comes next: the n-th point of a source is the slot of its n-th
block. The sequence goes on until every source has the blocks of its target; points of a source
that has them are passed over. A source that must give more words than it has starts over, at
most once.

Defined results: a null text has no words, and a document without words takes part with none.
A null source is a source. Repeated rows each take their part. An empty table gives an empty
result. Columns besides ``doc_id``, ``text`` and ``source`` take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.positions import running_start
from trolley.llm.stages import staged, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SLOTS = 1 << 16
SEED = 8
GOLDEN = 0.6180339887498949
CELLS = 1024
ROUNDS = 4


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized_documents(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, source and size of each row, with a number for the row."""
    number = F.monotonically_increasing_id() if row is None else row
    return staged(
        docs.select("doc_id", "source", word_count().alias("size"), number.alias("row")), "sized"
    )


def source_targets(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """One row for each source: source, source_size, weight and target.

    Targets share ``share`` of all words by weight and stop at ``most`` times a source's size.
    With the sources sorted by the level at which they stop, the level of the rest is the
    highest that any prefix of stopped sources leaves.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    stops = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    rest = stops.rowsBetween(0, Window.unboundedFollowing)
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("stop", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn(
            "level",
            (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / F.sum("weight").over(rest),
        )
        .withColumn("level", F.max("level").over(everything))
        .select(
            "source",
            "source_size",
            "weight",
            F.least("cap", F.col("level") * F.col("weight")).alias("target"),
        )
    )


def schedule(targets: DataFrame, slots: int = SLOTS, golden: float = GOLDEN) -> DataFrame:
    """source, rank, first and end of each block to take, and its slot in the mix.

    A block has the targets' sum divided by ``slots`` words, so there are about ``slots`` of
    them however large the corpus. ``first`` and ``end`` count along the source's repeated
    stream; its last block ends at the target. Gaps between the points are so even that
    ``ROUNDS`` times as many points as blocks have each source's blocks; should a sequence leave
    some out, they follow at the end.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    blocks = staged(
        targets.withColumn("need", F.round("target").cast("long"))
        .withColumn(
            "words", F.greatest(F.ceil(F.sum("need").over(everything) / slots), F.lit(1))
        )
        .withColumn("blocks", F.ceil(F.col("need") / F.col("words")))
        .withColumn("at", F.row_number().over(in_order))
        .withColumn("sources", F.count("*").over(everything))
        .withColumn("total", F.sum("blocks").over(everything))
        .withColumn("hi", F.sum("blocks").over(in_order))
        .withColumn("lo", F.col("hi") - F.col("blocks")),
        "blocks",
    )
    total = blocks.agg(F.max("total")).first()[0] or 0
    cell = F.floor(F.col("point") * CELLS / total)
    points = (
        targets.sparkSession.range(ROUNDS * total)
        .withColumn("point", (((F.col("id") + 0.5) * golden) % 1.0) * total)
        .withColumn("cell", cell)
    )
    intervals = blocks.where("blocks > 0").withColumn(
        "cell",
        F.explode(
            F.sequence(F.floor(F.col("lo") * CELLS / total), F.floor(F.col("hi") * CELLS / total))
        ),
    )
    drawn = points.join(intervals, "cell").where("lo <= point and point < hi")
    ranked = drawn.select(
        "at", "id", (F.row_number().over(Window.partitionBy("at").orderBy("id")) - 1).alias("rank")
    )
    wanted = blocks.where("blocks > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("rank")
    )
    late = F.lit(ROUNDS * total) + F.col("rank") * F.col("sources") + F.col("at")
    return wanted.join(ranked, ["at", "rank"], "left").select(
        "source",
        "rank",
        (F.col("rank") * F.col("words")).alias("first"),
        F.least((F.col("rank") + 1) * F.col("words"), F.col("need")).alias("end"),
        F.coalesce("id", late).alias("slot"),
        "words",
    )


def mix(
    docs: DataFrame,
    slots: int = SLOTS,
    seed: int = SEED,
    golden: float = GOLDEN,
    row: Column | None = None,
    **shares: float,
) -> DataFrame:
    """The pieces of documents in the mix, and documents without one.

    A row has row, doc_id, source, size, source_size, target and, for a piece, its slot, the
    pass over the source and the words ``from_word`` to ``to_word`` of the document.
    """
    sized = sized_documents(docs, row)
    targets = staged(source_targets(sized, **shares), "targets")
    plan = staged(schedule(targets, slots, golden), "schedule")
    words = plan.agg(F.max("words")).first()[0] or 1
    limit = targets.withColumnRenamed("source", "_source").drop("weight")
    placed = running_start(sized, "source", "size", "row", seed).join(
        limit, F.col("source").eqNullSafe(F.col("_source"))
    )
    passes = (
        placed.drop("_source")
        .withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size"))
        .withColumn("finish", F.col("begin") + F.col("size"))
        .withColumn("live", (F.col("size") > 0) & (F.col("begin") < F.col("target")))
        .where("live or pass = 0")
    )
    pieces = passes.withColumn(
        "_rank",
        F.explode_outer(
            F.when(
                F.col("live"),
                F.sequence(
                    F.floor(F.col("begin") / words), F.floor((F.col("finish") - 1) / words)
                ),
            )
        ),
    )
    blocks = plan.select(
        F.col("source").alias("_source"), F.col("rank").alias("_of"), "first", "end", "slot"
    )
    scheduled = F.col("slot").isNotNull()
    return (
        pieces.join(
            blocks,
            F.col("source").eqNullSafe(F.col("_source")) & (F.col("_rank") == F.col("_of")),
            "left",
        )
        .withColumn("from_word", F.when(scheduled, F.greatest("begin", "first") - F.col("begin")))
        .withColumn("to_word", F.when(scheduled, F.least("finish", "end") - F.col("begin")))
        .select(
            *("row", "doc_id", "source", "size", "source_size", "target"),
            *("slot", "pass", "from_word", "to_word"),
        )
    )


def words_taken(
    docs: DataFrame, slots: int = SLOTS, seed: int = SEED, golden: float = GOLDEN
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken.

    ``first_slot`` is the slot of the first block with words of the document, and ``blocks`` how
    many there are; null and 0 if the mix takes none.
    """
    words = F.col("to_word") - F.col("from_word")
    return (
        mix(docs, slots, seed, golden)
        .groupBy("row", "doc_id", "source", "size", "source_size", "target")
        .agg(
            F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"),
            F.min("slot").alias("first_slot"),
            F.count("slot").alias("blocks"),
        )
        .drop("row")
    )


def mixed_documents(docs: DataFrame, golden: float = GOLDEN) -> DataFrame:
    """The documents of ``docs`` in the order of the schedule.

    A document is in the mix once for each pass over its source that takes at least half of its
    words, at the slot where these begin. Rows are numbered and written first, so that rows that
    share an id, or are equal, each have their own place.
    """
    row, own, slot = (unused(docs, name) for name in ("_row", "_own", "_slot"))
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    words = F.col("to_word") - F.col("from_word")
    taken = staged(
        mix(numbered, golden=golden, row=F.col(row))
        .where("slot is not null")
        .groupBy(F.col("row").alias(own), "pass", "size")
        .agg(F.sum(words).alias("taken"), F.min("slot").alias(slot))
        .where("taken * 2 >= size")
        .select(own, slot),
        "taken",
    )
    return (
        numbered.join(taken, F.col(row) == F.col(own))
        .repartitionByRange(slot, row)
        .sortWithinPartitions(slot, row)
        .select(*docs.columns)
    )
