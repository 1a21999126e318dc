"""Stored tables: buckets, keyed rewrites, single appends, kept partials, numbering, sketches, trigrams."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from musterline.operators import explore, partials, reconcile, reports, sketches, trigrams
from musterline.operators.numbering import copies, numbered
from musterline.plans import catalog, standins as V
from musterline.sources import buckets, keyed, sinks
from musterline.sources.storage import work_folder

ROSTER = "manager_id string, employee_id string, full_name string, company_email string, department string"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- buckets ------------------------------------------------------------------------------


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture()
def sides(spark):
    rand = random.Random(4)
    roster = [(rand.choice(["m1", "m1", "m2", None]), rand.choice([f" {i}", str(i), f"{i}\t"]), f"n{i}", None, "d") for i in range(300)]
    roster += roster[:30] + [("m3", None, "x", "y", "z"), ("m3", "  ", "x", "y", "z")]
    sheet = [(rand.choice(["m1", "m2", "m4"]), f"{rand.randrange(400)} ") for _ in range(500)]
    return spark.createDataFrame(roster, ROSTER).repartition(3), spark.createDataFrame(sheet, "manager_id string, employee_id string").repartition(5)


def test_buckets_meet_without_an_exchange(spark, tmp_path, no_broadcast, sides):
    roster, sheet = sides
    tables = [buckets.store(df, f"{tmp_path}/{n}", n, buckets=6) for n, df in (("roster", roster), ("sheet", sheet))]
    found = reconcile.reconcile_buckets(*tables)
    assert rows_of(found) == rows_of(reconcile.reconcile_with_details(roster, sheet))
    plan = plan_of(found)
    assert "Exchange" not in plan and plan.count("SelectedBucketsCount: 6 out of 6") >= 2
    for n in ("roster", "sheet"):
        assert len(glob.glob(f"{tmp_path}/{n}/part-*")) == 6  # a bucket is a file


def test_unequal_buckets_are_shuffled_and_give_the_same(spark, tmp_path, no_broadcast, sides):
    roster, sheet = sides
    tables = [buckets.store(df, f"{tmp_path}/{n}", n, buckets=b) for n, df, b in (("roster", roster, 5), ("sheet", sheet, 7))]
    found = reconcile.reconcile_buckets(*tables)
    assert rows_of(found) == rows_of(reconcile.reconcile_with_details(roster, sheet))
    assert "Exchange" in plan_of(found)


def test_a_large_owner_lies_in_all_buckets(spark, tmp_path):
    one = spark.range(4000).select(F.lit("m").alias("manager_id"), F.col("id").cast("string").alias("employee_id"))
    table = buckets.store(one, f"{tmp_path}/t", buckets=8)
    sizes = [r[0] for r in spark.read.parquet(f"{tmp_path}/t").groupBy(F.input_file_name()).count().select("count").collect()]
    assert table.count == 8 and len(sizes) == 8 and max(sizes) < 700


# --- keyed rewrites -----------------------------------------------------------------------


def files(path):
    return {os.path.relpath(p, path): os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/*/part-*")}


def test_only_changed_buckets_are_rewritten(spark, tmp_path):
    base = spark.createDataFrame([(i, f"s{i % 3}", None if i % 4 else f"w{i}") for i in range(200)], "id long, status string, who string")
    table = keyed.create(base, f"{tmp_path}/t", "id", buckets=32)
    before = files(table.path)
    assert len(before) == 32
    # 7 changes twice and ends as it was; 9 is set to null; 5 gets a value; 1000 is unknown.
    batch = spark.createDataFrame([(7, 1, "no", "no"), (7, 2, "s1", "w7" if 7 % 4 == 0 else None), (9, 3, None, None), (5, 4, "new", "x"), (1000, 5, "a", "b")], "id long, seq long, status string, who string")
    written = keyed.apply(table, batch, ["seq"], ["status", "who"])
    want = {r[0]: tuple(r) for r in base.collect()} | {9: (9, None, None), 5: (5, "new", "x")}
    assert rows_of(keyed.read(spark, table)) == sorted(want.values(), key=repr)
    after = files(table.path)
    changed = {p.split("/")[0] for p in set(before) ^ set(after)}
    assert changed == {f"_bucket={b}" for b in written} and 1 <= len(written) <= 2
    assert all(after[p] == t for p, t in before.items() if p.split("/")[0] not in changed)
    assert keyed.apply(table, batch, ["seq"], ["status", "who"]) == []
    assert files(table.path) == after


def test_no_changes_and_changes_of_nothing(spark, tmp_path):
    table = keyed.create(spark.range(5).withColumn("v", F.lit("a")), f"{tmp_path}/t", "id", buckets=4)
    none = spark.createDataFrame([], "id long, seq long, v string")
    assert keyed.apply(table, none, ["seq"], ["v"]) == []
    unknown = spark.createDataFrame([(77, 1, "b")], "id long, seq long, v string")
    assert keyed.apply(table, unknown, ["seq"], ["v"]) == []
    assert rows_of(keyed.read(spark, table)) == [(i, "a") for i in range(5)]


# --- single appends ---------------------------------------------------------------------------


def test_a_batch_is_appended_once(spark, tmp_path, monkeypatch):
    table, one = f"{tmp_path}/audit", spark.range(3)
    assert sinks.append_once(one, table, 1)
    assert not sinks.append_once(one, table, 1)

    # Killed between writing and publishing: nothing shows, and the repeat leaves each record once.
    write = type(one.write).parquet

    def dies(writer, path, *args, **options):
        write(writer, path, *args, **options)
        raise KeyboardInterrupt

    monkeypatch.setattr(type(one.write), "parquet", dies)
    with pytest.raises(KeyboardInterrupt):
        sinks.append_once(spark.range(10, 12), table, 2)
    monkeypatch.undo()
    assert spark.read.parquet(table).count() == 3
    assert sinks.append_once(spark.range(10, 12), table, 2)
    assert rows_of(spark.read.parquet(table)) == [(0, 1), (1, 1), (10, 2), (11, 2), (2, 1)]
    sinks.clear_staged(spark, table)
    assert not os.path.exists(f"{table}/_staged") and spark.read.parquet(table).count() == 5


def test_of_two_attempts_one_counts(spark, tmp_path, monkeypatch):
    """Another attempt publishes while this one is writing."""
    table = f"{tmp_path}/t"
    write = type(spark.range(1).write).parquet
    rivals = [spark.range(1)]

    def races(writer, path, *args, **options):
        write(writer, path, *args, **options)
        if rivals:
            assert sinks.append_once(rivals.pop(), table, 5)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", races)
    assert not sinks.append_once(spark.range(100, 103), table, 5)
    monkeypatch.undo()
    assert rows_of(spark.read.parquet(table)) == [(0, 5)]


# --- kept partials --------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_kept_dashboard_equals_recomputation(spark, tmp_path, seed):
    rand = random.Random(seed)
    statuses = ["COMPLETED", "FAILED", "PROCESSING", None]
    current = {i: (rand.choice(["a", "b", "c", None]), rand.choice(["EMPLOYEE_DATA", "GETS_SHEET"]), rand.choice(statuses)) for i in range(60)}
    schema = "id long, uploaded_by string, category string, status string"

    def frame(ids, of):
        return spark.createDataFrame([(i, *of[i]) for i in ids], schema)

    measures = partials.upload_measures()
    kept = partials.Kept(spark, f"{tmp_path}/k", measures)
    ids = sorted(current)
    rand.shuffle(ids)
    known = ids[:20]
    assert kept.add(partials.signed(frame(known, current)), 0)
    for batch in range(1, 4):
        fresh = [i for i in ids if i not in known][:13]
        again = rand.sample(known, 6)
        changed = current | {i: (rand.choice(["a", "d"]), current[i][1], rand.choice(statuses)) for i in again}
        gone = [i for i in known if i not in again][:2]
        rows = partials.corrections(frame(again, current), frame(again, changed)).unionByName(partials.signed(frame(fresh, current)))
        rows = rows.unionByName(partials.signed(frame(gone, current), -1))
        assert kept.add(rows, batch) and not kept.add(rows, batch)
        current, known = changed, [i for i in known + fresh if i not in gone]
        if batch == 2:
            assert kept.fold() and not kept.fold()
            assert not kept.add(rows, 1)  # in the fold already
        whole = partials.merged(partials.partial(partials.signed(frame(known, current)), measures), measures)
        assert rows_of(kept.dashboard()) == rows_of(whole)


# --- numbering ------------------------------------------------------------------------------


def test_numbers_are_dense_in_any_group(spark):
    rand = random.Random(9)
    rows = [(rand.choice(["big"] * 8 + ["small", None, ""]), rand.randrange(10**6), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, k long, i long").repartition(7)
    found = numbered(df, ["g"], ["k", "i"], "no")
    assert found.columns == ["g", "k", "i", "no"]
    got = {}
    for r in found.collect():
        got.setdefault(r["g"], []).append((r["k"], r["i"], r["no"]))
    for group, own in got.items():
        assert [n for *_, n in sorted(own)] == list(range(1, len(own) + 1)), group
    assert sum(map(len, got.values())) == 5000


def test_a_large_group_is_numbered_by_several_tasks(spark):
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        df = spark.range(8000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 8000).alias("k"))
        found = numbered(df, ["g"], ["k"], "no")
        plan = found._jdf.queryExecution().executedPlan().toString()
        for window in [line for line in plan.splitlines() if "Window [" in line]:
            assert "_rows" in window  # sums over partitions, not over rows
        spread = found.groupBy(F.spark_partition_id()).count().count()
        assert spread > 1 and found.where("no <> k + 1").count() == 0
    finally:
        spark.conf.unset(conf)


def test_no_rows_are_numbered(spark):
    assert numbered(spark.createDataFrame([], "g string, k long"), ["g"], ["k"], "no").collect() == []


def test_copies(spark):
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 6)], "x string, n long")
    got = rows_of(copies(df, "n", "c", step=3).select("x", "c"))
    assert got == sorted((x, c) for x, n in (("a", 1), ("b", 7), ("c", 6)) for c in range(1, n + 1))


def test_numbered_report_of_an_owner_with_many_equal_lines(spark):
    roster = spark.createDataFrame([("m", None, None, None, "d")] * 50 + [("m", "7", "n", None, "d")] * 3 + [("n", "1", "x", "e@x", None)], ROSTER)
    sheet = spark.createDataFrame([("m", "7")], "manager_id string, employee_id string")
    names = spark.createDataFrame([("m", "Ann")], "manager_id string, name string")
    parts = (reconcile.summarise(roster, sheet), names, reconcile.department_headcount_by_owner(roster), reconcile.reconcile(roster, sheet), reconcile.without_email(roster))
    lines = reports.numbered_lines(*parts).collect()
    plain = reports.report_lines(*parts).collect()
    assert sorted((r["manager_id"], r["section_no"], r["line_key"], r["line"]) for r in lines) == sorted(map(tuple, plain))
    for owner in ("m", "n"):
        own = sorted((r for r in lines if r["manager_id"] == owner), key=lambda r: r["line_no"])
        assert [r["line_no"] for r in own] == list(range(1, len(own) + 1))
        assert [(r["section_no"], r["line_key"], r["line"]) for r in own] == sorted((r["section_no"], r["line_key"], r["line"]) for r in own)
        assert (own[0]["line"], own[-1]["line"]) == ("== Roster compliance report", "== End of report")


# --- sketches -------------------------------------------------------------------------------


def test_sketches_are_exact_while_small(spark, data_dir):
    roster, sheet = V.roster(spark, data_dir), V.sheet(spark, data_dir)
    made = sketches.compare(*(sketches.id_sketches(x, ["manager_id"]) for x in (roster, sheet)))
    assert rows_of(made) == rows_of(reconcile.summarise(roster, sheet).drop("missing_email"))


def test_large_sets_stay_within_the_bounds(spark):
    """Four standard errors of a union of 2**12 hashes, for each of several owners and months."""
    ids = spark.range(120_000).withColumn("manager_id", F.concat(F.lit("m"), F.col("id") % 3))
    roster = ids.select("manager_id", F.col("id").cast("string").alias("employee_id"))
    sheet = ids.where("id % 10 < 8").select("manager_id", F.concat(F.lit(" "), "id").alias("employee_id"), (F.col("id") % 4).alias("month"))
    sheet = sheet.unionByName(ids.where("id % 10 = 0").select("manager_id", (F.col("id") + 10**6).cast("string").alias("employee_id"), F.lit(5).cast("long").alias("month")))
    exact = {r["manager_id"]: r for r in reconcile.summarise(roster.withColumn("company_email", F.lit("x")), sheet).collect()}
    months = sketches.id_sketches(sheet, ["manager_id", "month"])
    found = sketches.compare(sketches.id_sketches(roster, ["manager_id"]), sketches.merged(months, ["manager_id"])).collect()
    assert len(found) == 3
    for r in found:
        union = exact[r["manager_id"]]["roster_count"] + exact[r["manager_id"]]["unknown"]
        for n in ("roster_count", "sheet_count", "matched", "missing", "unknown"):
            assert abs(r[n] - exact[r["manager_id"]][n]) <= 4 * union / 2**6, n


def test_sketched_summary_is_exact_beyond_one_sketch(spark, tmp_path):
    """One manager with 20,000 IDs, one with a few, in the tables that the query reads."""
    customers = spark.range(1, 20_051).selectExpr(
        "id c_custkey", "'n' || id c_name", "1.0D c_acctbal", "'m' c_mktsegment", "if(id > 20000, 2, 1) c_nationkey")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 60_000).selectExpr("id o_orderkey", "1 + id * 7919 % 20050 o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    exact = reconcile.summarise(V.roster(spark, str(tmp_path)), V.sheet(spark, str(tmp_path))).drop("missing_email")
    assert rows_of(catalog.sketched_summary(spark, str(tmp_path))) == rows_of(exact)


def test_owners_on_one_side_and_no_ids(spark):
    roster = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3")], "manager_id string, employee_id string")
    sheet = spark.createDataFrame([("b", "1"), ("b", " "), ("c", None)], "manager_id string, employee_id string")
    made = sketches.compare(*(sketches.id_sketches(x, ["manager_id"]) for x in (roster, sheet)))
    assert rows_of(made) == [("a", 2, 0, 0, 2, 0, 0.0, "HIGH"), ("b", 0, 1, 0, 0, 1, 0.0, "HIGH")]


# --- trigrams -------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["build", "BuIl", "c1_@ex%ple", "omer#0000000", "%", "a", "", "zzzz", "ÄÖÜ", "i%n", "100%", "com\\%", "İst", "e@f"])
def test_index_finds_what_the_scan_finds(spark, data_dir, tmp_path, text):
    extra = spark.createDataFrame([("m", "x1", "äöü ÄÖÜ", "e@f.x", None), ("m", "x2", "100% build\\", "", "İstanbul"), ("m", "x3", "bui ild", None, "uil")], ROSTER)
    roster = V.roster(spark, data_dir).unionByName(extra)
    trigrams.build(roster, f"{tmp_path}/i", "employee_id")
    found = trigrams.search(roster, trigrams.open_index(spark, f"{tmp_path}/i"), "employee_id", text)
    assert rows_of(found) == rows_of(explore.search_roster(roster, text))


def test_trigrams_reach_the_index_scan(spark, data_dir, tmp_path):
    roster = V.roster(spark, data_dir)
    trigrams.build(roster, f"{tmp_path}/i", "employee_id")
    found = trigrams.search(roster, trigrams.open_index(spark, f"{tmp_path}/i"), "employee_id", "build")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [bui,ild,uil])" in plan and "PartitionFilters: [_bucket" in plan


class _Session:
    """As much of a session as says where it runs."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_intermediates_go_to_the_shared_folder():
    assert work_folder(_Session("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert os.path.isdir(work_folder(_Session("local[4]"))) and work_folder(_Session("local[4]")) == work_folder(_Session("local[2]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            work_folder(_Session(master))
