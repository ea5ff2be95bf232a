"""Batches of sequences of nearly equal length, each padded to its longest.

Rows are dealt out by ranges of length and sorted within them, so that the whole table is in order without any task seeing more
than its range. Their ranks are each partition's rows before (a sum over as many numbers as there are partitions) and the place
within the partition; batches are ranks divided by the size. The target of a batch is the longest of it, a grouped maximum.

Null sequences count as empty and stay null. Ties of length go by the key, then by content; rows that are alike in all are told
apart by chance, which changes nothing in what comes out, so they don't end in one range. The last batch may be smaller. Empty
tables give empty ones. Columns of df with the names of the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import expr
from .lineage import cut

#: Bits of a row's place in its partition, in Spark's increasing ids.
PLACE = 33


def ranked(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """df with each row's rank (from 0) in an order; written once on the way, as ranks need the sizes of all ranges before."""
    names = [f"__order{k}" for k in range(len(order))]
    keyed = df.drop(out).select("*", *(c.alias(n) for c, n in zip(order, names)))
    placed = cut(keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names).withColumn("__place", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("__place", PLACE), F.col("__place").bitwiseAND((1 << PLACE) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("__before"))
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + place).drop("__part", "__before", "__place")


def batched(df: DataFrame, size: int, key: Sequence[str], ids: str = "ids", multiple: int = 1) -> DataFrame:
    """df with batch, place (in the batch) and target: the longest of the batch, rounded up to a multiple."""
    if size < 1 or multiple < 1:
        raise ValueError("size and multiple must be positive")
    length = F.coalesce(F.when(F.size(ids) >= 0, F.size(ids)), F.lit(0))
    rows = ranked(df.drop("batch", "place", "target", "__rank"), [length, *(F.col(k) for k in key), F.xxhash64(ids), F.rand(1)], "__rank")
    rows = rows.withColumns({"batch": F.floor(F.col("__rank") / size).cast("long"), "place": (F.col("__rank") % size).cast("int")}).drop("__rank")
    longest = rows.groupBy("batch").agg(expr.rounded(F.max(length), multiple).alias("target"))
    return rows.join(longest, "batch")


def padded(df: DataFrame, size: int, key: Sequence[str], ids: str = "ids", multiple: int = 1, pad_id: int = 0, left: bool = False) -> DataFrame:
    """batched(), with the sequences filled up to their batch's target."""
    return batched(df, size, key, ids, multiple).withColumn(ids, expr.pad(F.col(ids), F.col("target"), pad_id, left))
