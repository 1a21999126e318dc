"""The registered queries: SQL where there is some, the pipeline stage by stage otherwise."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from musterline.llm import queries
from tests.llm import odd
from tests.llm.test_ngram_join import shingles


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from read_parquet('{path}')")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_query_equals_sql(spark, duck, data_dir, name):
    ours = queries.queries()[name](spark, data_dir)
    theirs = duck.execute(queries.statements()[name])
    columns = sorted(d[0] for d in theirs.description)
    assert sorted(ours.columns) == columns
    order = [[d[0] for d in theirs.description].index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[i] for i in order) for r in theirs.fetchall()))) == sorted(map(repr, (tuple(r[c] for c in columns) for r in ours.collect())))


def test_the_queries_and_the_pipeline():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.queries()) <= names and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def rows_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()), key=repr)


def test_one_of_each_group_stays(spark):
    docs = odd.frame(spark)
    kept = corpus_pipeline.keep_one_of_each(spark, odd.clashing(docs), "")
    assert set(docs.columns) <= set(kept.columns)
    found = rows_of(kept)
    # 2 to 4 are copies of 1, 9 of 8; one of two equal rows of 16 stays; the texts of 17 differ; a null ID is a document too.
    assert [i for i, t in found if shingles(t) and i is not None] == sorted([1, 8, 10, 11, 12, 13, 14, 15, 16, 17, 17], key=str)
    assert [i for i, t in found if shingles(t) and i is None] == [None]
    assert sum(1 for _, t in found if not shingles(t)) == sum(1 for r in odd.rows() if not shingles(r[1]))


def test_leaks_go_and_clean_documents_stay(spark, tmp_path):
    spark.createDataFrame([(1, odd.prose(2, 60, 5000)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_leaks(spark, odd.clashing(odd.frame(spark)), str(tmp_path))
    assert rows_of(kept) == sorted(((r[0], r[1]) for r in odd.rows() if r[0] not in (10, 11)), key=repr)


def labels_of(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_good_documents_stay_with_all_their_columns(spark, tmp_path):
    """What the classifier accepts, whatever else the rows carry; it learns from labels alone."""
    from musterline.llm import quality

    labels_of(spark, tmp_path, [(1, 1, 0), (13, 0, 0), (12, 1, 0), (15, 0, 1), (None, 1, 0), (500, 1, 0), (10, 1, 0)])
    docs = odd.clashing(odd.frame(spark))
    kept = corpus_pipeline.keep_good(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.learn(docs, labels.where(corpus_pipeline.remainder(F.col("doc_id"), 4) != 2))
    want = docs.withColumn("score", quality.scorer(spark, model)(F.col("text"))).where("score >= 0.7")
    assert rows_of(kept) == rows_of(want) and kept.where("_row_key <> 7 or top <> 7").count() == 0


def test_columns_called_like_inner_ones_stay(spark, tmp_path):
    spark.createDataFrame([(1, odd.prose(2, 60, 5000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.clashing(odd.frame(spark))
    for stage in (corpus_pipeline.keep_one_of_each, corpus_pipeline.drop_leaks, corpus_pipeline.mix_sources):
        out = stage(spark, docs, str(tmp_path))
        assert sorted(out.columns) == sorted(docs.columns), stage.__name__
        inner = [c for c in docs.columns if c not in odd.SCHEMA.names]
        assert out.where(" or ".join(f"`{c}` is null or `{c}` <> 7" for c in inner)).count() == 0, stage.__name__
    sharded = corpus_pipeline.into_shards(spark, docs, "")
    assert set(docs.columns) <= set(sharded.columns) and sharded.count() == docs.count()


def test_stages_and_pipeline_without_rows(spark, tmp_path):
    odd.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, tmp_path, [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.empty(spark), str(tmp_path))
        assert out.collect() == [] and set(odd.SCHEMA.names) <= set(out.columns), name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_lengths_are_counted_once(spark):
    """However many sums read the histogram, each text is encoded once."""
    import pyarrow as pa

    from musterline.llm import token_counts

    seen = spark.sparkContext.accumulator(0)

    def length(texts: pa.Array) -> pa.Array:
        seen.add(len(texts))
        return pa.array([len(t.as_py() or "") for t in texts], pa.int64())

    docs = odd.frame(spark)
    sums = token_counts.histogram(docs.select(F.arrow_udf(length, "long")("text").alias("length")))
    assert sums.agg(F.sum("n_docs")).first()[0] == len(odd.rows())
    token_counts.at_limits(sums, [5, 100]).collect()
    assert seen.value == len(odd.rows())


def test_mixing_runs_no_python(spark, data_dir):
    plan = queries.op10_mixing(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_repeats_rows(spark):
    docs = odd.clashing(odd.frame(spark))
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    times = {}
    for r in rows_of(mixed):
        times[r] = times.get(r, 0) + 1
    rows = [(r[0], r[1]) for r in odd.rows()]
    assert times and all(n <= 2 * rows.count(r) for r, n in times.items())


def test_pipeline_runs_through(spark, data_dir):
    out = corpus_pipeline.run(spark, data_dir)
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    assert set(docs.columns) <= set(out.columns) and out.count() > 0
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    good = out.select("doc_id").distinct().join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert good > 0.95
    kept = out.select("doc_id", "text").distinct().collect()
    sets = [shingles(r["text"]) for r in kept]
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            assert not both or 100 * both < 75 * (len(sets[i]) + len(sets[j]) - both)
