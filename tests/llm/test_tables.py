"""Helpers: bit tables by size, settings that come back, tables that go."""

import os

import numpy as np

from musterline.llm import bits, tables
from pyspark.sql import functions as F


def test_bit_tables_hold_their_keys_at_any_size(spark):
    keys = spark.range(3000, numPartitions=3).select(F.xxhash64("id").alias("key"))
    own = np.array([r[0] for r in keys.collect()], np.int64)
    others = np.array([r[0] for r in spark.range(10_000, 13_000).select(F.xxhash64("id")).collect()], np.int64)
    for size in (1 << 16, 1 << 20, bits.BITS):
        table = bits.bit_table(keys, size)
        assert len(table) * 8 == size
        assert bits.member(table, own).all()
        assert bits.member(table, others).mean() < 1.5 * 3000 / size + 0.002
    assert not bits.member(bits.bit_table(keys.where("false"), 1 << 16), own).any()


def test_room_grows_with_the_keys_to_a_limit():
    sizes = [bits.room(n) for n in (0, 1, 5000, 10**6, 10**8, 10**12)]
    assert sizes == sorted(sizes) and all(s & (s - 1) == 0 for s in sizes)
    assert sizes[0] == 1 << 16 and sizes[-1] == bits.LARGEST
    assert all(bits.room(n) >= 16 * n for n in (5000, 10**6, 6 * 10**7))


def test_batch_size_comes_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        with tables.in_batches_of(spark, 7):
            assert spark.conf.get(name) == "7"
            raise RuntimeError
    except RuntimeError:
        pass
    assert spark.conf.get(name) == before


def test_written_tables_go(spark):
    table = tables.written(spark.range(5), "numbers")
    assert table.count() == 5 and os.path.isdir(table.llm_path.removeprefix("file:"))
    tables.discard(table)
    assert not os.path.exists(table.llm_path.removeprefix("file:"))
