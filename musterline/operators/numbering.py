"""Numbering rows within groups of any size.

``row_number()`` over a group pulls the whole group through one task.  Here rows are laid out by
range over group and order, so a large group is a run of neighbouring partitions; a row's number
is the count of its group in earlier partitions plus its place within its own.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from musterline.sources.storage import parked

_AT, _PART = "_at", "_part"


def numbered(df: DataFrame, by: list[str], order: list[str], into: str) -> DataFrame:
    """``df`` with a dense number from 1 in column ``into``, per ``by`` and in order of ``order``.

    Two shuffles of the rows at most, and one of a row per group and partition.  Rows that are equal in
    ``by`` and ``order`` share a task and are numbered in any order; nulls come first and are a group.
    """
    keys = [*by, *order]
    # The place is fixed by writing it: partition in the upper bits, row of the partition in the lower.
    laid = parked(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id()), "numbered"
    ).withColumn(_PART, F.shiftright(_AT, 33))
    runs = laid.groupBy(*by, _PART).agg(F.min(_AT).alias("_first"), F.count("*").alias("_rows"))
    # A window row per partition that a group reaches into, never per row.
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    starts = runs.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(by)], F.col(_PART).alias("_rp"), (F.col("_before") - F.col("_first") + 1).alias("_shift"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(by)], F.col(_PART) == F.col("_rp"))
    return laid.join(starts, same).select(*df.columns, (F.col(_AT) + F.col("_shift")).alias(into))


def copies(df: DataFrame, count: str, into: str, step: int = 10_000) -> DataFrame:
    """Each row ``count`` times, told apart by ``into`` from 1; no array is longer than ``step``."""
    last = F.col(count) - 1
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / step))))
    inside = F.sequence(F.col("_block") * step + 1, F.least(F.col(count), (F.col("_block") + 1) * step))
    return blocks.withColumn(into, F.explode(inside)).drop("_block")
