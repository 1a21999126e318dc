"""ID pairs stored by bucket, so that tables compared again and again are never shuffled again.

A table of ``(owner, ID)`` rows is dealt into buckets by a hash of both, one file and one sort order
per bucket.  Two tables with equal buckets are grouped and joined bucket by bucket; where the
numbers differ Spark shuffles as usual and the rows are the same.  A roster is stored once and
meets every month's sheet.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from musterline.functions import clean_id

ID = "employee_id"


@dataclass(frozen=True)
class Buckets:
    """A stored table: its catalog name, owner column and number of buckets."""

    name: str
    by: str
    count: int


def store(df: DataFrame, path: str, label: str = "ids", by: str = "manager_id", buckets: int | None = None) -> Buckets:
    """``df`` stored by bucket under ``path``, IDs cleaned; rows without owner or ID are left out.

    ``buckets`` should give files of some 100 to 500 MB and must be equal for tables that meet; by default
    it is the number of shuffle partitions.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    cleaned = df.withColumn(ID, clean_id(ID)).where(F.col(by).isNotNull() & F.col(ID).isNotNull())
    # Dealt as the buckets are, so each bucket is written by one task as one file.
    dealt = cleaned.repartition(count, by, ID)
    dealt.write.bucketBy(count, by, ID).sortBy(by, ID).option("path", path).saveAsTable(name)
    return Buckets(name, by, count)


def open_buckets(spark: SparkSession, table: Buckets) -> DataFrame:
    return spark.table(table.name)
