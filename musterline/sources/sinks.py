"""Writing results: history appends, partitioned text reports, workbook tables, JSON."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from musterline.operators.reports import in_reading_order


def append_records(df: DataFrame, path: str) -> None:
    """Append history, audit or status rows to a Parquet table; a repeat appends again (see :func:`append_once`)."""
    df.write.mode("append").parquet(path)


def append_once(df: DataFrame, table: str, batch_id: int | str) -> bool:
    """Append the rows of a batch under ``batch_id=<id>``; False if that batch is there already.

    Rows go to a folder that readers do not see, and one rename publishes them all.  A batch that was
    stopped before the rename has left nothing visible, and repeating it leaves each row once; of two
    attempts at once the first rename wins.  The file system has to rename folders atomically.
    """
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    final = jvm.Path(f"{table}/batch_id={batch_id}")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(final):
        return False
    staged = jvm.Path(f"{table}/_staged/{batch_id}-{uuid.uuid4().hex}")
    df.write.parquet(staged.toString())
    files.mkdirs(final.getParent())
    # A rename onto a folder that has come meanwhile would move ours into it: look again, and undo that.
    if files.exists(final) or not files.rename(staged, final):
        files.delete(staged, True)
        return False
    inside = jvm.Path(final, staged.getName())
    if files.exists(inside):
        files.delete(inside, True)
        return False
    return True


def clear_staged(spark: SparkSession, table: str) -> None:
    """Remove what stopped batches have left; no batch may be running."""
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_staged")
    staged.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged, True)


def write_partition(df: DataFrame, table: str, **partition) -> str:
    """(Re)write one partition directory, so that repeating a batch changes nothing."""
    place = table + "".join(f"/{name}={value}" for name, value in partition.items())
    df.write.mode("overwrite").parquet(place)
    return place


def publish(df: DataFrame, table: str, **partition) -> DataFrame:
    """Write one partition and hand back what was written.

    What follows reads files instead of carrying the lineage of ``df``; the schema is
    passed on, so no footers are opened to find it.
    """
    place = write_partition(df, table, **partition)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def write_reports(lines: DataFrame, path: str, by: str = "manager_id") -> None:
    """One directory per owner holding its report as text.

    Lines are range-partitioned in reading order: part files of an owner, read by name,
    follow one another, and a large owner is written by several tasks.
    """
    in_reading_order(lines, by).select(by, F.col("line").alias("value")).write.mode("overwrite").partitionBy(
        by
    ).text(path)


def write_issue_workbook(issues: DataFrame, counts: DataFrame, path: str, fmt: str = "csv") -> None:
    """The two workbook sheets as two tables, ``summary`` and ``issues``."""
    ordered = issues.orderBy("issue_order", *[c for c in issues.columns if c != "issue_order"])
    for name, df in (("summary", counts), ("issues", ordered)):
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(f"{path}/{name}")
        else:
            writer.format(fmt).save(f"{path}/{name}")


def write_documents(documents: DataFrame, path: str) -> None:
    """Nested result documents as JSON lines."""
    documents.write.mode("overwrite").json(path)
