"""Stored files as rows: ``path``, ``filename``, ``size_bytes``, ``content``."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from musterline import constants as K
from musterline.functions import content_hash, extension, file_type, reader_for, sanitized

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def as_inventory(binary_files: DataFrame) -> DataFrame:
    """Columns of a ``binaryFile`` scan under our names; times become zone-less UTC."""
    modified = F.col("modificationTime").cast("timestamp_ntz")
    return binary_files.select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        F.col("length").alias("size_bytes"),
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), modified).alias("created_at"),
        "content",
    )


def owner_in_path() -> Column:
    """The manager a file belongs to, from a ``manager_id=<id>`` folder; empty without one."""
    return F.regexp_extract("path", r"/manager_id=([^/]+)/", 1)


def read_files(spark: SparkSession, path: str, max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """Files up to ``max_bytes``; larger ones are skipped by their length, unread.

    List them with :func:`oversized_files`.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return as_inventory(scan.where(F.col("length") <= max_bytes))


def all_files(scan: DataFrame, beyond: DataFrame, max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """Every file of two equal ``binaryFile`` scans: with content up to ``max_bytes``, without (and unread) beyond."""
    large = beyond.where(F.col("length") > max_bytes).select("path", "modificationTime", "length")
    return as_inventory(scan.where(F.col("length") <= max_bytes).unionByName(large, allowMissingColumns=True))


def oversized_files(spark: SparkSession, path: str, max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """The files :func:`read_files` leaves out; content is not read."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return as_inventory(scan.where(F.col("length") > max_bytes)).drop("content")


def file_inventory(files: DataFrame) -> DataFrame:
    """Hash, type, reader and stored name per file, without the content."""
    ext = extension("filename")
    return files.select(
        "path", "filename", sanitized("filename").alias("stored_name"), "size_bytes", "created_at",
        ext.alias("extension"), file_type(ext).alias("file_type"), reader_for(ext).alias("reader"),
        content_hash("content").alias("file_hash"),
    )
