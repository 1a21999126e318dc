"""A stored table that is changed by key: only the buckets a batch changes are written anew.

Rows lie in ``_bucket=<n>`` folders by a hash of their key.  A batch of changes is reduced to the newest
per key, meets the rows of its own buckets alone (the others are not even listed), and
buckets in which some value really differs are overwritten through Spark's dynamic partition
overwrite.  A batch that is applied again differs nowhere and writes nothing.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from musterline.operators.changes import apply_changes
from musterline.sources.storage import parked

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    path: str
    key: str
    buckets: int
    schema: str


def _bucket(table: KeyedTable) -> Column:
    return F.pmod(F.xxhash64(table.key), F.lit(table.buckets)).cast("int")


def _write(df: DataFrame, table: KeyedTable) -> None:
    """Rows to their buckets, one task a bucket, so a bucket is one file."""
    dealt = df.withColumn(BUCKET, _bucket(table)).repartition(BUCKET)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(table.path)


def create(df: DataFrame, path: str, key: str, buckets: int) -> KeyedTable:
    """A new table.  Take enough buckets that one fits a task and a batch touches few; the number is fixed."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    table = KeyedTable(path.rstrip("/"), key, buckets, fields)
    _write(df, table)
    return table


def _stored(spark: SparkSession, table: KeyedTable) -> DataFrame:
    return spark.read.schema(f"{table.schema}, {BUCKET} int").parquet(table.path)


def read(spark: SparkSession, table: KeyedTable) -> DataFrame:
    return _stored(spark, table).drop(BUCKET)


def apply(table: KeyedTable, changes: DataFrame, order: list[str], columns: list[str]) -> list[int]:
    """Set ``columns`` to the newest change per key; returns the buckets that were written.

    Changes of unknown keys are dropped, a change may set a null.  Bucket numbers are all that
    reaches the driver.  One writer at a time: the last of two would win a bucket.
    """
    spark = changes.sparkSession
    newest = parked(
        changes.groupBy(table.key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_new"))
        .select(table.key, "_new.*").withColumn(BUCKET, _bucket(table)), "changes",
    )
    reached = [r[0] for r in newest.select(BUCKET).distinct().collect()]
    if not reached:
        return []
    base = _stored(spark, table).where(F.col(BUCKET).isin(reached))
    old = base.select(table.key, BUCKET, F.struct(*columns).alias("_old"))
    differs = ~F.col("_old").eqNullSafe(F.struct(*columns))
    changed = old.join(newest.drop(BUCKET), table.key).where(differs).select(BUCKET).distinct()
    written = sorted(r[0] for r in changed.collect())
    if written:
        touched = F.col(BUCKET).isin(written)
        fresh = newest.where(touched).drop(BUCKET).withColumn("_one", F.lit(1))
        rows = apply_changes(base.where(touched).drop(BUCKET), fresh, table.key, ["_one"], columns)
        # Parked first: the files that are read are the ones to be replaced.
        _write(parked(rows, "rewritten"), table)
    return written
