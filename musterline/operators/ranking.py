"""Top-k and latest-row helpers.

``row_number() <= k`` is planned with a group limit in front of the shuffle, so each task
sends at most k rows per group however many rows a group has.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; ``rank`` names an output column for the position."""
    position = rank or "_position"
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(position, F.row_number().over(w)).where(F.col(position) <= k)
    return kept if rank else kept.drop(position)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Newest ``values`` per key by grouping; a null in ``order`` is older than any value."""
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_v")).select(*keys, "_v.*")
