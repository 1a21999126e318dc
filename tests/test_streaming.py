import glob
import os

import pytest
from pyspark.sql import functions as F

from musterline.operators import dashboards, reconcile
from musterline.plans import standins as V
from musterline.streaming import live
from musterline.streaming.sheets import SheetJob, process_batch, sheet_stream


def drop(inbox, manager, name, text):
    folder = f"{inbox}/manager_id={manager}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


@pytest.fixture()
def place(spark, tmp_path):
    roster = spark.createDataFrame([
        ("m 1", "1", "x@y", "Ops"), ("m 1", "2", None, "Dev"), ("m2", "5", "x@y", None), ("m3", "6", "x@y", None),
    ], "manager_id string, employee_id string, company_email string, department string")
    users = spark.createDataFrame(
        [("m 1", "Ann", "ann@x", "MANAGER"), ("m2", "Bob", "bob@x", "MANAGER")],
        "id string, name string, email string, role string",
    )
    job = SheetJob(f"{tmp_path}/out", lambda: roster, lambda: users)

    def run(per_batch=1000):
        query = sheet_stream(spark, f"{tmp_path}/in", job, f"{tmp_path}/checkpoint", per_batch)
        running = query.trigger(availableNow=True).start()
        running.awaitTermination()

    def table(name):
        return spark.read.parquet(job.table(name))

    return f"{tmp_path}/in", job, run, table, roster


def test_sheets_are_processed_as_they_arrive(spark, place):
    inbox, job, run, table, roster = place
    drop(inbox, "m 1", "jan.csv", "Emp ID,Name\n 1 ,A\n1,A\n9,B\n")
    drop(inbox, "m2", "jan.csv", "Employee ID\n")
    drop(inbox, "m2", "notes.pdf", "x")
    drop(inbox, "m2", "book.xlsx", "y")
    drop(inbox, "m2", "odd.csv", "Badge\n1\n")
    drop(inbox, "m4", "new.csv", "Employee ID\n")
    run()
    drop(inbox, "m 1", "again.csv", "Emp ID,Name\n 1 ,A\n1,A\n9,B\n")
    drop(inbox, "m 1", "feb.csv", "Employee ID\n1\n2\n")
    run()

    summary = {(r.manager_id, r.filename): r for r in table("summary").collect()}
    assert set(summary) == {("m 1", "jan.csv"), ("m2", "jan.csv"), ("m 1", "feb.csv")}
    jan = summary[("m 1", "jan.csv")]
    assert (jan.matched, jan.missing, jan.unknown, jan.missing_email, jan.compliance_score) == (1, 1, 1, 1, 50.0)
    empty = summary[("m2", "jan.csv")]
    assert (empty.roster_count, empty.missing, empty.risk_level) == (1, 1, "HIGH")
    assert summary[("m 1", "feb.csv")].risk_level == "LOW"

    verdicts = {(r.manager_id, r.filename): r.verdict for r in table("inventory").collect()}
    assert verdicts[("m 1", "again.csv")] == "IN_HISTORY"
    assert verdicts[("m2", "notes.pdf")] == "BAD_EXTENSION" and verdicts[("m2", "book.xlsx")] == "UNREADABLE"
    # Same bytes as another file of the batch: one of the two is taken, by path.
    assert verdicts[("m4", "new.csv")] == "REPEATED_IN_BATCH"

    last = dashboards.job_status(table("status_events"), "path", ("created_at", "step"), ("status", "reason"))
    status = {os.path.basename(r.path): (r.status, r.reason) for r in last.collect() if "m4" not in r.path}
    assert status["feb.csv"] == ("COMPLETED", None) and status["odd.csv"] == ("FAILED", "NO_ID_COLUMN")
    assert status["again.csv"] == ("FAILED", "IN_HISTORY")
    assert table("notifications").count() == 3 and table("report_history").count() == 3
    uploads = {(r.filename, r.uploaded_by): (r.category, r.status) for r in table("upload_history").collect()}
    assert uploads == {
        ("jan.csv", "ann@x"): ("GETS_SHEET", "COMPLETED"), ("jan.csv", "bob@x"): ("GETS_SHEET", "COMPLETED"),
        ("odd.csv", "bob@x"): ("GETS_SHEET", "FAILED"), ("feb.csv", "ann@x"): ("GETS_SHEET", "COMPLETED"),
    }
    assert {r.action for r in table("audit_logs").collect()} == {"BACKGROUND_GETS_PROCESS"}
    reports = glob.glob(f"{job.table('reports')}/batch_id=*/file_hash=*/part-*")
    assert any("Manager: Ann" in open(r).read() for r in reports)


def test_stream_equals_batch_and_a_replay_changes_nothing(spark, place, tmp_path):
    inbox, job, run, table, roster = place
    for i, manager in enumerate(["m 1", "m2", "m3"]):
        drop(inbox, manager, "s.csv", f"Employee ID\n{i}\n{i + 1}\n5\n")
    run(per_batch=1)
    sheet = spark.createDataFrame(
        [(m, str(v)) for i, m in enumerate(["m 1", "m2", "m3"]) for v in (i, i + 1, 5)],
        "manager_id string, employee_id string",
    )
    counts = ["manager_id", "roster_count", "sheet_count", "matched", "missing", "unknown", "missing_email", "compliance_score", "risk_level"]
    batch = {tuple(r) for r in reconcile.summarise(roster, sheet).select(*counts).collect()}
    assert {tuple(r) for r in table("summary").select(*counts).collect()} == batch

    names = ("inventory", "summary", "issues", "report_history", "upload_history", "status_events", "pairs")
    before = {n: sorted(map(str, table(n).drop("created_at", "generated_at", "filename").collect())) for n in names}
    from musterline.sources.inventory import read_files

    done = [r.path for r in spark.read.parquet(job.table("inventory")).where("batch_id = 1").collect()]
    again = read_files(spark, inbox).where(F.col("path").isin(done)).withColumn(
        "manager_id", F.regexp_extract("path", "/manager_id=([^/]+)/", 1)
    )
    process_batch(again, 1, job)
    after = {n: sorted(map(str, table(n).drop("created_at", "generated_at", "filename").collect())) for n in names}
    assert after == before


@pytest.fixture(scope="module")
def pieces(spark, data_dir, tmp_path_factory):
    """Histories as directories of several files each, to be streamed file by file."""
    root = str(tmp_path_factory.mktemp("pieces"))
    for name in ("upload_history", "audit_logs"):
        df = getattr(V, name)(spark, data_dir)
        df.repartitionByRange(3, "created_at").write.parquet(f"{root}/{name}")
    return root


def stream(spark, pieces, name):
    schema = spark.read.parquet(f"{pieces}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{pieces}/{name}")


def finish(df, name, mode, tmp_path):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.table(name)


def same(a, b):
    return sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_live_job_status_ends_at_the_batch_answer(spark, pieces, data_dir, tmp_path):
    live_rows = finish(live.live_job_status(stream(spark, pieces, "upload_history")), "live_status", "complete", tmp_path)
    assert same(live_rows, dashboards.job_status(V.upload_history(spark, data_dir)))


def test_every_file_gets_a_record(spark, place, tmp_path):
    inbox, job, _, table, _ = place
    small = SheetJob(job.out, job.roster, job.users, max_bytes=40)
    drop(inbox, "m 1", "ok.csv", "Employee ID\n1\n")
    drop(inbox, "m 1", "big.csv", "Employee ID\n" + "1\n" * 50)
    drop(inbox, "m2", "notes.pdf", "x")
    sheet_stream(spark, inbox, small, f"{tmp_path}/checkpoint2").trigger(availableNow=True).start().awaitTermination()
    assert {r.filename: r.verdict for r in table("inventory").collect()} == {
        "ok.csv": "NEW", "big.csv": "TOO_LARGE", "notes.pdf": "BAD_EXTENSION",
    }
    failed = {os.path.basename(r.path): r.reason for r in table("status_events").where("status = 'FAILED'").collect()}
    assert failed == {"big.csv": "TOO_LARGE", "notes.pdf": "BAD_EXTENSION"}


def test_live_counters_end_at_the_batch_answer(spark, pieces, data_dir, tmp_path):
    uploads = finish(live.live_upload_counts(stream(spark, pieces, "upload_history")), "live_uploads", "complete", tmp_path)
    assert same(uploads, live.live_upload_counts(V.upload_history(spark, data_dir)))
    actions = finish(live.live_action_counts(stream(spark, pieces, "audit_logs")), "live_actions", "complete", tmp_path)
    assert same(actions, live.live_action_counts(V.audit_logs(spark, data_dir)))


def test_daily_activity_equals_batch_for_closed_days(spark, pieces, data_dir, tmp_path):
    batch = dashboards.audit_daily(V.audit_logs(spark, data_dir))
    whole = finish(live.daily_activity(stream(spark, pieces, "audit_logs"), "60 days"), "daily_all", "complete", tmp_path)
    assert same(whole, batch)
    closed = finish(live.daily_activity(stream(spark, pieces, "audit_logs"), "60 days"), "daily_closed", "append", tmp_path)
    assert closed.exceptAll(batch.select(*closed.columns)).count() == 0


def test_unique_files_keeps_one_row_per_hash(spark, pieces, data_dir, tmp_path):
    hashes = V.upload_history(spark, data_dir).select("file_hash").distinct().count()
    kept = finish(live.unique_files(stream(spark, pieces, "upload_history")), "unique_all", "append", tmp_path)
    assert kept.count() == kept.select("file_hash").distinct().count() == hashes
    bounded = live.unique_files(stream(spark, pieces, "upload_history"), "created_at", "400 days")
    assert finish(bounded, "unique_bounded", "append", tmp_path).count() == hashes
