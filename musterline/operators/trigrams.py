"""Substring search through an index of trigrams.

The index has a row per trigram and row key.  A search looks up the trigrams of the pattern's literal
parts, keeps the keys that have them all, and verifies only these rows with the exact pattern, so
wildcards, order and place count as in a scan.  A pattern without three literal characters in a row, or
one that is escaped, is answered by the scan.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from musterline.functions import contains_any
from musterline.operators.explore import SEARCH_COLUMNS

BUCKETS = 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _grams(text: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - 2)
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3)))))


def build(df: DataFrame, path: str, key: str, columns: tuple = SEARCH_COLUMNS) -> None:
    """Write the index of ``df``: trigrams of the lower-cased columns, by bucket and sorted by trigram.

    Every row sends each of its trigrams once; a trigram that most rows have is many index rows, dealt by
    key as well, so no bucket file is one task's.
    """
    names = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in columns])
    posts = df.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.flatten(F.filter(F.transform(names, _grams), lambda g: g.isNotNull())))).alias("gram"))
    dealt = posts.withColumn("_bucket", _bucket(F.col("gram"))).repartition("_bucket", F.pmod(F.xxhash64("_key"), F.lit(8)))
    dealt.sortWithinPartitions("_bucket", "gram").write.partitionBy("_bucket").parquet(path)


def literal_grams(text: str) -> set[str] | None:
    """Trigrams that every match must have; None where the pattern says too little."""
    if "\\" in text:
        return None
    parts = [p.lower() for p in re.split("[%_]", text)]
    return {p[i : i + 3] for p in parts for i in range(len(p) - 2)} or None


def search(df: DataFrame, index: DataFrame, key: str, text: str, columns: tuple = SEARCH_COLUMNS) -> DataFrame:
    """The rows :func:`explore.search_roster` finds in ``df``, by way of its index.

    ``key`` is unique in ``df``.  The trigrams of a pattern are few, so their filter reaches the index
    scan; what joins ``df`` is the keys that have all of them.
    """
    grams = literal_grams(text)
    found = contains_any(columns, text)
    if grams is None or any(g.lower() != g or len(g) != 3 for g in grams):
        return df.where(found) if text else df
    spark = df.sparkSession
    buckets = sorted(r[0] for r in spark.createDataFrame([(g,) for g in sorted(grams)], "gram string").select(_bucket(F.col("gram"))).distinct().collect())
    hits = index.where(F.col("_bucket").isin(buckets) & F.col("gram").isin(sorted(grams)))
    keys = hits.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") == len(grams))
    return df.join(keys, F.col(key) == F.col("_key"), "left_semi").where(found)


def open_index(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    return spark.read.schema(f"_key {key_type}, gram string, _bucket int").parquet(path)
