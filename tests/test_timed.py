"""Timed state and interval joins: streams against tables, over restarts, with late and repeated events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from musterline.streaming import lifecycle, timed

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.unset(name)


def at(days):
    return START + dt.timedelta(days=days)


class Stream:
    """Batches of rows as Parquet files, one run of the query a batch, always from the same checkpoint."""

    def __init__(self, spark, folder, schema, build):
        self.spark, self.folder, self.schema, self.build = spark, folder, schema, build
        spark.createDataFrame([], schema).write.parquet(f"{folder}/in")
        self.n = 0

    def rows(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        return self

    def run(self):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        query = (
            self.build(source).writeStream.outputMode("append").format("parquet").option("path", f"{self.folder}/out")
            .option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        self.state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return self

    def found(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.folder}/out").collect()), key=repr)


FILES = "id long, file_hash string, filename string, created_at timestamp_ntz"


def test_a_hash_is_repeated_for_the_horizon_then_new(spark, tmp_path):
    stream = Stream(spark, f"{tmp_path}/s", FILES, lambda s: timed.first_within(s, 5 * DAY))
    stream.rows([(1, "h", "a", at(0)), (2, "h", "b", at(1)), (3, "k", "c", at(1))]).run()
    stream.rows([(4, "h", "d", at(4.9)), (5, "k", "e", at(6.5))]).run()  # another run: state outlives it
    stream.rows([(6, "h", "f", at(5.6)), (7, "h", "g", at(9))]).run()
    verdicts = {r[0]: r[3] for r in stream.found()}
    assert verdicts == {1: "NEW", 2: "REPEATED", 3: "NEW", 4: "REPEATED", 5: "NEW", 6: "NEW", 7: "REPEATED"}


def test_state_is_forgotten_behind_the_horizon(spark, tmp_path):
    stream = Stream(spark, f"{tmp_path}/s", FILES, lambda s: timed.first_within(s, 2 * DAY, lateness="1 hour"))
    for day in range(0, 18, 3):
        stream.rows([(100 * day + i, f"h{day}-{i}", "x", at(day)) for i in range(20)])
    stream.run()
    assert len(stream.found()) == 120
    assert max(stream.state) <= 3 * 2 * 20 and stream.state[-1] <= 3 * 20  # values and timers of some two batches


def test_files_of_a_table_follow_the_same_rule(spark):
    rows = [(i, "h", "x", at(i * 0.7)) for i in range(20)]
    got = {r["id"]: r["verdict"] for r in timed.first_within(spark.createDataFrame(rows, FILES).repartition(3), 3 * DAY).collect()}
    want, last = {}, None
    for i, _, _, t in rows:
        new = last is None or t - last >= 3 * DAY
        want[i], last = ("NEW", t) if new else ("REPEATED", last)
    assert got == want


EVENTS = "id long, job string, status string, created_at timestamp_ntz"


def some_events(seed):
    rand = random.Random(seed)
    times = sorted(rand.uniform(0, 40) for _ in range(120))
    return [(i, f"j{rand.randrange(6)}", rand.choice(["PROCESSING", "PROCESSING", "COMPLETED", "FAILED"]), at(t)) for i, t in enumerate(times)]


def test_watched_jobs_equal_the_table(spark, tmp_path):
    events = some_events(1)
    stream = Stream(spark, f"{tmp_path}/s", EVENTS, lambda s: timed.watched_jobs(s, 2 * DAY))
    for i in range(0, 120, 40):
        stream.rows(events[i : i + 40])
        if i == 40:
            stream.run()  # a restart between batches
    stream.rows([(1000, "clock", "COMPLETED", at(60))]).rows([(1001, "clock", "COMPLETED", at(61))]).run()
    table = timed.ended_jobs(spark.createDataFrame(events, EVENTS).repartition(3), 2 * DAY)
    assert stream.found() == sorted(map(tuple, table.collect()), key=repr)
    assert stream.state[-1] == 0  # nothing runs any more, nothing is remembered


def test_a_job_that_nobody_ends_fails_by_its_timer(spark, tmp_path):
    stream = Stream(spark, f"{tmp_path}/s", EVENTS, lambda s: timed.watched_jobs(s, DAY, lateness="1 hour"))
    stream.rows([(1, "a", "PROCESSING", at(0)), (2, "b", "PROCESSING", at(0)), (3, "c", "COMPLETED", at(0))])
    stream.rows([(4, "b", "COMPLETED", at(0.5))]).rows([(5, "x", "COMPLETED", at(3))]).rows([(6, "a", "COMPLETED", at(4))]).run()
    assert stream.found() == [("a", at(0), at(1), "FAILED", timed.NO_END), ("b", at(0), at(0.5), "COMPLETED", None)]


# --- uploads and their ends ---------------------------------------------------------------------

UPLOADS = "id long, owner string, uploaded_at timestamp_ntz"
ENDS = "id long, owner string, status string, ended_at timestamp_ntz"


class Pair:
    def __init__(self, spark, folder, within, lateness="1 day"):
        self.spark, self.folder, self.within, self.lateness = spark, folder, within, lateness
        for name, schema in (("uploads", UPLOADS), ("ends", ENDS)):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")

    def batch(self, uploads, ends):
        for name, schema, rows in (("uploads", UPLOADS, uploads), ("ends", ENDS, ends)):
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")
        left, right = (self.spark.readStream.schema(s).parquet(f"{self.folder}/{n}") for n, s in (("uploads", UPLOADS), ("ends", ENDS)))
        query = (
            lifecycle.outcomes(left, right, self.within, self.lateness).writeStream.outputMode("append").format("parquet")
            .option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        self.progress = query.recentProgress

    def found(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.folder}/out").collect()), key=repr)


def test_late_missing_and_repeated_events(spark, tmp_path):
    pair = Pair(spark, f"{tmp_path}/p", "2 days")
    pair.batch([(1, "a", at(0)), (2, "b", at(0)), (1, "a", at(0))], [(10, "a", "COMPLETED", at(1))])
    pair.batch([(3, "a", at(1.5))], [(10, "a", "COMPLETED", at(1)), (11, "b", "FAILED", at(2.5))])  # 10 again; 11 too long after 2
    pair.batch([(4, "c", at(20))], [(12, "c", "COMPLETED", at(20.1))])
    pair.batch([(5, "a", at(0.5))], [(13, "a", "COMPLETED", at(0.6))])  # later than the watermark allows
    pair.batch([(6, "z", at(40))], [(14, "y", "FAILED", at(40))])
    pair.batch([(7, "z", at(41))], [(15, "y", "FAILED", at(41))])
    assert [(r[0], r[3]) for r in pair.found() if r[0] < 6] == [(1, 10), (2, None), (3, None), (4, 12)]


def test_streams_equal_tables(spark, tmp_path):
    rand = random.Random(2)
    uploads = [(i, f"o{rand.randrange(5)}", at(i * 0.3)) for i in range(60)]
    ends = [(100 + i, f"o{rand.randrange(5)}", rand.choice(["COMPLETED", "FAILED"]), at(i * 0.3 + rand.random())) for i in range(60)]
    pair = Pair(spark, f"{tmp_path}/p", "36 hours", "2 days")
    for i in range(0, 60, 20):
        pair.batch(uploads[i : i + 20], ends[i : i + 20] + ends[max(0, i - 2) : i])
    pair.batch([(900, "clock", at(90))], [(901, "clock2", "FAILED", at(90))])
    pair.batch([(902, "clock", at(95))], [(903, "clock2", "FAILED", at(95))])
    left, right = spark.createDataFrame(uploads, UPLOADS), spark.createDataFrame(ends + ends[:5], ENDS)
    table = lifecycle.outcomes(left, right, "36 hours")
    assert [r for r in pair.found() if r[0] < 900] == sorted(map(tuple, table.collect()), key=repr)


def test_joined_state_is_bounded(spark, tmp_path):
    pair = Pair(spark, f"{tmp_path}/p", "1 day", "1 hour")
    for day in range(0, 30, 5):
        pair.batch([(day * 10 + i, f"o{i}", at(day)) for i in range(10)], [(1000 + day * 10 + i, f"o{i}", "COMPLETED", at(day + 0.1)) for i in range(10)])
    joins = [o["numRowsTotal"] for p in pair.progress for o in p["stateOperators"] if "Join" in o["operatorName"]]
    assert joins and max(joins) <= 40
