"""Dashboards kept up to date by what a batch adds, without reading history again.

A partial is a row of counts per key: what a batch of rows contributes, with a sign.  Partials
add up: those of two batches, or of a batch and the correction that takes rows of it back, merge by
summing, in any order and grouping.  So a dashboard is the stored partials plus the newest
batch, and merging cuts the stored ones to a row per key again.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from musterline import constants as K
from musterline.sources.sinks import append_once

SIGN = "sign"


@dataclass(frozen=True)
class Measures:
    """Keys to group by and conditions to count; ``rows`` counts all."""

    keys: tuple[str, ...]
    conditions: tuple[tuple[str, Column], ...] = ()

    @property
    def names(self) -> list[str]:
        return ["row_count", *[name for name, _ in self.conditions]]


def upload_measures() -> Measures:
    """What dashboards show of uploads: by owner, category and status."""
    category, status = F.col("category"), F.col("status")
    return Measures(("uploaded_by",), (
        ("roster_files", category == K.ROSTER_FILE), ("sheet_files", category == K.SHEET_FILE),
        ("completed", status == K.STATUS_COMPLETED), ("failed", status == K.STATUS_FAILED),
    ))


def signed(df: DataFrame, sign: int = 1) -> DataFrame:
    """Rows to be added (1) or taken back (-1)."""
    return df.withColumn(SIGN, F.lit(sign))


def corrections(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that replace others: the old ones count off, the new ones count."""
    return signed(before, -1).unionByName(signed(after))


def partial(rows: DataFrame, measures: Measures) -> DataFrame:
    """One row per key of signed rows: copies are reduced before the shuffle."""
    sign = F.col(SIGN).cast("long")
    sums = [F.sum(sign).alias("row_count")]
    sums += [F.sum(F.when(condition, sign).otherwise(F.lit(0).cast("long"))).alias(name) for name, condition in measures.conditions]
    return rows.groupBy(*measures.keys).agg(*sums)


def merged(partials: DataFrame, measures: Measures) -> DataFrame:
    """Partials of one key added up; keys all of whose rows were taken back go."""
    total = partials.groupBy(*measures.keys).agg(*[F.sum(n).alias(n) for n in measures.names])
    return total.where(" or ".join(f"{n} <> 0" for n in measures.names))


class Kept:
    """Stored partials of a dashboard: a folder per batch, and a fold of all batches up to some number.

    Batches are numbered in the order they are added.
    """

    def __init__(self, spark: SparkSession, path: str, measures: Measures):
        self.spark, self.path, self.measures = spark, path.rstrip("/"), measures

    def add(self, rows: DataFrame, batch_id: int) -> bool:
        """Take a batch of signed rows in; a batch that is there already, or folded, changes nothing."""
        if batch_id <= self._folded():
            return False
        return append_once(partial(rows, self.measures), f"{self.path}/batches", batch_id)

    def dashboard(self) -> DataFrame:
        """The sum of the newest fold and the batches behind it; at least one batch must have been added."""
        upto = self._folded()
        names = [*self.measures.keys, *self.measures.names]
        batches = [f"{self.path}/batches/batch_id={n}" for n in self._numbers("batches") if n > upto]
        tables = [f"{self.path}/folds/batch_id={upto}"] if upto >= 0 else []
        return merged(self.spark.read.parquet(*tables, *batches).select(*names), self.measures)

    def fold(self) -> bool:
        """Sum everything up to the newest batch into one row per key.

        The fold is published whole; the folders it holds are not read any more and may be removed.
        """
        newest = max([self._folded(), *self._numbers("batches")])
        return append_once(self.dashboard(), f"{self.path}/folds", newest)

    def _folded(self) -> int:
        return max(self._numbers("folds"), default=-1)

    def _numbers(self, table: str) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return [int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")]
