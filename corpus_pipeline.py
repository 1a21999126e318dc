"""From raw documents to shards: quality, near duplicates, benchmark leaks, source mix, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before kept. Rows and
columns of documents pass through unchanged; filters remove rows, the mix repeats some.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterline.llm import decontaminate, mixing, ngram_join, quality, sharding
from musterline.llm.tables import read, remainder, shared_folder, written


def _carried(docs: DataFrame) -> DataFrame:
    """ID and text hash of each row, and the row as one value, whatever its columns are called."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), F.struct(*docs.columns).alias("row"))


def _same(rows: DataFrame, keys: DataFrame):
    """A row is known by its ID (null is a value) and its text."""
    return (rows["key"] == keys["row_key"]) & rows["id"].eqNullSafe(keys["doc_id"])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good.

    It learns from the labelled documents of the input whose crc32 modulo 4 is not 2; labels without a document, or of a
    null ID, are not used, and with none at all every score is 0.5, so nothing stays. A null or empty text is
    scored like any other, equal rows get equal scores, a text is scored whole however long. No rows give no rows.
    """
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.learn(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    return docs.where(quality.scorer(spark, model)(F.col("text")) >= 0.7)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least ID, then of the least row key.

    Texts without words (null, empty) are in no group and all stay. Of equal rows one stays; a null ID comes
    last. Texts are compared whole, however long. No rows give no rows.
    """
    joined = ngram_join.ngram_join(docs).rows
    grouped = joined.where("class is not null")
    first = written(
        grouped.groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("r"), F.count("*").alias("n")).select("r.doc_id", "r.row_key"),
        "first",
    )
    bare = joined.where("class is null").select("doc_id", "row_key").distinct()
    carried = _carried(docs)
    # Equal rows (same ID, same text) would all pass the join; they are few or none, and one of them stays.
    twins = written(grouped.groupBy("doc_id", "row_key").count().where("count > 1").join(first.withColumnsRenamed({"doc_id": "d", "row_key": "k"}), F.expr("row_key = k and doc_id <=> d"), "left_semi").select("doc_id", "row_key"), "twins")
    single = first.join(twins.withColumnsRenamed({"doc_id": "d", "row_key": "k"}), F.expr("row_key = k and doc_id <=> d"), "left_anti")
    stay = written(single.union(bare), "stay")
    kept = carried.join(stay, _same(carried, stay), "left_semi")
    if not twins.isEmpty():
        again = carried.join(twins, _same(carried, twins), "left_semi")
        kept = kept.union(again.dropDuplicates(["id", "key"]))
    return kept.select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts, and items, contain and are nothing; equal rows share their fate. Long texts are searched
    whole. No rows, or no items, change nothing.
    """
    found = written(decontaminate.contained(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "row_key").distinct(), "leaks")
    carried = _carried(docs)
    return carried.join(found, _same(carried, found), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, one row for each time a document is taken, in whole or at its source's limit in part.

    A null source is a source. Null and empty texts have no words and are not taken. Equal rows of one ID at the limit
    share what is left and all come. Long texts count all their words. No rows give no rows.
    """
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))  # whatever other columns are called
    mixed = mixing.mix(whole, F.array("source")).documents
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return mixed.where("taken > 0").select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard.

    Null and empty texts are sharded by ID; equal rows that no bit can part go to pages; a text beyond the
    limit is alone and marked. No rows give no rows.
    """
    return sharding.shards(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

ORACLE_SQL = None  # SQL has no counterpart of the classifier; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
