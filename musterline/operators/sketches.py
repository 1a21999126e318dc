"""Comparing ID sets through theta sketches: distinct counts that merge over months and owners.

A sketch holds the smallest hashes of a set, ``2 ** size`` at most, whatever the set's size, so a
year's sheets of a manager merge from twelve small rows instead of from raw IDs.  Union, intersection
and difference of sketches estimate matched, missing and unknown.  Up to ``2 ** size`` IDs the numbers
are exact; beyond, the relative standard error of a count is about ``2 ** (-size / 2)``, and that of an
intersection or difference grows with the ratio of union to result.

Sets of any size are counted exactly by dividing them: sketches of whole sets tell which owners outgrow one
sketch and how far (:func:`outgrown`), their IDs are dealt by hash into parts of about a quarter of a sketch
(:func:`divided`), and the sizes of the parts add up.  IDs are told apart by 63-bit hashes within a part.
"""

from pyspark.sql import Column, DataFrame, functions as F

from musterline.functions import clean_id
from musterline.operators.reconcile import with_score

SIZE = 12


def id_sketches(df: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """``(keys, ids)``: one sketch per key; partial sketches are what is shuffled."""
    named = df.withColumn("_id", clean_id("employee_id")).where(F.col("_id").isNotNull())
    return named.groupBy(*keys).agg(F.theta_sketch_agg("_id", size).alias("ids"))


def merged(sketches: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Sketches of fewer keys: those that now share a key are united."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("ids", size).alias("ids"))


def _size_of(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")


def outgrown(sketches: DataFrame, by: str = "manager_id", size: int = SIZE) -> DataFrame:
    """``(by, parts)`` of the owners whose IDs on all sides together no longer fit one sketch."""
    sizes = merged(sketches, [by], size).select(by, _size_of(F.col("ids")).alias("n"))
    return sizes.where(F.col("n") >= 2**size).selectExpr(by, f"n div {2 ** (size - 2)} + 1 as parts")


def divided(df: DataFrame, large: DataFrame, by: str = "manager_id") -> DataFrame:
    """The rows with ``part``: 0 but for owners in ``large``, whose IDs are dealt by a hash other than the sketch's."""
    part = F.pmod(F.xxhash64(clean_id("employee_id")), F.coalesce("parts", F.lit(1)))
    return df.join(large, by, "left").withColumn("part", part).drop("parts")


def compare(roster: DataFrame, sheet: DataFrame, by: str = "manager_id", part: str | None = None) -> DataFrame:
    """Set sizes, score and risk per owner from two tables of sketches; exact where each sketch holds its whole set.

    With ``part``, sketches are keyed by owner and part, and an owner's sizes are the sums over its parts.
    """
    keys = [by, part] if part else [by]
    both = roster.select(*keys, F.col("ids").alias("r")).join(sheet.select(*keys, F.col("ids").alias("s")), keys, "full_outer")
    common = F.when(F.col("r").isNotNull() & F.col("s").isNotNull(), F.theta_intersection("r", "s"))
    missing = F.when(F.col("s").isNull(), F.col("r")).when(F.col("r").isNotNull(), F.theta_difference("r", "s"))
    unknown = F.when(F.col("r").isNull(), F.col("s")).when(F.col("s").isNotNull(), F.theta_difference("s", "r"))
    sizes = {"roster_count": F.col("r"), "sheet_count": F.col("s"), "matched": common, "missing": missing, "unknown": unknown}
    counts = both.where(F.col(by).isNotNull()).select(by, *[_size_of(x).alias(n) for n, x in sizes.items()])
    return with_score(counts.groupBy(by).agg(*[F.sum(n).alias(n) for n in sizes]) if part else counts)
