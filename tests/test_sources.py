import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from musterline.operators import ingest, reconcile, reports
from musterline.plans.monthly import run_month
from musterline.plans.roster_upload import import_roster_files
from musterline.sources import inventory, sheets, sinks, tables


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


def test_csv_keeps_ids_as_text_and_names_the_sheet(spark, tmp_path):
    write(f"{tmp_path}/a.csv", "Employee ID,Note\n007,x\n,y\n1e3,z\n")
    write(f"{tmp_path}/b.csv", "Employee ID,Note\n7.0,w\n")
    df = ingest.rename_headers(sheets.read_csv(spark, str(tmp_path)))
    rows = {(r.employee_id, os.path.basename(r.sheet_file)) for r in df.collect()}
    assert rows == {("007", "a.csv"), (None, "a.csv"), ("1e3", "a.csv"), ("7.0", "b.csv")}


def test_csv_with_another_header_is_refused_instead_of_misread(spark, tmp_path):
    write(f"{tmp_path}/a.csv", "Employee ID,Name\n1,x\n")
    write(f"{tmp_path}/b.csv", "Name,Employee ID\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        sheets.read_csv(spark, str(tmp_path)).collect()


def test_mixed_headers_are_parsed_file_by_file(spark, tmp_path):
    write(f"{tmp_path}/a.csv", "Name, EMP ID ,Badge\nAnn,007,1\n\n\"B\nob\",8\n")
    write(f"{tmp_path}/b.csv", "﻿Associate Id,Employee ID,Email,Site Leave\n9,10,x@y,2\n")
    write(f"{tmp_path}/c.csv", "Name\nAnn\n")
    write(f"{tmp_path}/d.csv", "Employee ID\nÄ\n", "latin-1")
    write(f"{tmp_path}/e.csv", "Employee ID\n")
    files = inventory.read_files(spark, str(tmp_path))
    rows = sheets.parse_sheets(files, ["filename"], {"site leave": "internal_leave"})
    found = {
        (r.filename, r.row_no): (r.employee_id, r.employee_name, r.company_email, r.internal_leave, r.problem)
        for r in rows.collect()
    }
    assert found == {
        ("a.csv", 1): ("007", "Ann", None, None, None),
        ("a.csv", 2): ("8", "B\nob", None, None, None),
        ("b.csv", 1): ("9", None, "x@y", "2", None),
        ("c.csv", 0): (None, None, None, None, "NO_ID_COLUMN"),
        ("d.csv", 0): (None, None, None, None, "NOT_TEXT"),
    }
    first = sheets.preview(rows.where("problem is null"), "filename", "row_no", 1)
    assert {(r.filename, r.row_no) for r in first.collect()} == {("a.csv", 1), ("b.csv", 1)}


def test_folder_of_sheets_feeds_the_comparison(spark, tmp_path):
    write(f"{tmp_path}/manager_id=m1/jan.csv", "Emp ID,Name\n 1,A\n")
    write(f"{tmp_path}/manager_id=m2/jan.CSV", "Name,Employee ID\nB,2\n")
    write(f"{tmp_path}/manager_id=m2/notes.pdf", "Employee ID\n3\n")
    sheet = sheets.read_sheets(spark, str(tmp_path)).where("problem is null")
    roster = spark.createDataFrame([("m1", "1", "x"), ("m2", "1", "x")], "manager_id string, employee_id string, company_email string")
    found = {tuple(r) for r in reconcile.reconcile(roster, sheet).collect()}
    assert found == {("m1", "1", "MATCHED"), ("m2", "1", "MISSING"), ("m2", "2", "UNKNOWN")}


def test_file_times_are_utc_in_any_session_zone(spark, tmp_path):
    write(f"{tmp_path}/a.csv", "x")
    os.utime(f"{tmp_path}/a.csv", (0, 3600))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        at = inventory.read_files(spark, str(tmp_path)).selectExpr("cast(created_at as string) t").first().t
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert at == "1970-01-01 01:00:00"


def test_large_sheet_is_parsed_whole(spark, tmp_path):
    n = 45_000
    write(f"{tmp_path}/big.csv", "Employee ID\n" + "\n".join(str(i) for i in range(n)) + "\n")
    rows = sheets.parse_sheets(inventory.read_files(spark, str(tmp_path)), ["path"])
    got = rows.agg(F.count("*"), F.countDistinct("employee_id"), F.max("row_no")).first()
    assert tuple(got) == (n, n, n)


def test_inventory(spark, tmp_path):
    odd = "a b+c%41;d.CSV"
    write(f"{tmp_path}/x/{odd}", "Employee ID\n1\n")
    write(f"{tmp_path}/y.pdf", "12345678901234567890")
    rows = {r.filename: r for r in inventory.file_inventory(inventory.read_files(spark, str(tmp_path))).collect()}
    assert rows[odd].file_hash == hashlib.sha256(b"Employee ID\n1\n").hexdigest()
    assert (rows[odd].reader, rows[odd].stored_name, rows[odd].size_bytes) == ("CSV", "a_b_c_41_d.CSV", 14)
    assert (rows["y.pdf"].file_type, rows["y.pdf"].reader) == ("PDF", "UNSUPPORTED")
    assert [r.filename for r in inventory.read_files(spark, str(tmp_path), max_bytes=14).collect()] == [odd]
    assert [r.filename for r in inventory.oversized_files(spark, str(tmp_path), max_bytes=14).collect()] == ["y.pdf"]


def test_profile(spark):
    df = spark.createDataFrame([("1", "x"), ("2", None)], ["Employee ID", "Note"])
    assert ingest.dataset_profile(df, "s").first().asDict() == {
        "dataset": "s", "columns": "Employee ID,Note", "column_count": 2, "row_count": 2
    }


def test_append_and_read_declared_table(spark, tmp_path):
    path = f"{tmp_path}/audit"
    row = "select '1' id, 'u@x' user_email, 'DOWNLOAD_REPORT' action, 'r' details, timestamp_ntz '2024-01-01 00:00:00' created_at"
    for _ in range(2):
        sinks.append_records(spark.sql(row), path)
    audit = tables.read_table(spark, path, "audit_logs")
    assert audit.count() == 2 and dict(audit.dtypes)["created_at"] == "timestamp_ntz"


def test_rewriting_a_partition_replaces_it(spark, tmp_path):
    for value in (1, 2):
        sinks.write_partition(spark.range(value), f"{tmp_path}/t", batch_id=7)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_text_slices_cover_everything_once():
    assert tables.text_slices("id", []) == ["1 = 1"]
    assert tables.text_slices("id", ["b", "o'x"]) == [
        "(id < 'b' OR id IS NULL)", "(id >= 'b' AND id < 'o''x')", "(id >= 'o''x')"
    ]
    with pytest.raises(ValueError):
        tables.text_slices("id", ["b", "a"])


@pytest.fixture(scope="module")
def month(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("month"))
    roster = spark.createDataFrame([
        ("m1", "1", "x@y", "Ops"), ("m1", "2", None, "Ops"), ("m2", "5", "x@y", None),
    ], "manager_id string, employee_id string, company_email string, department string")
    sheet = spark.createDataFrame(
        [("m1", " 1"), ("m1", "4"), ("m2", "5"), ("m3", "8")], "manager_id string, employee_id string"
    )
    users = spark.createDataFrame(
        [("m1", "Ann", "ann@x", "MANAGER"), ("m2", "Bob", "bob@x", "MANAGER"), ("h", "Hal", "h@x", "HR")],
        "id string, name string, email string, role string",
    )
    clock = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    for _ in range(2):  # The second run replaces the first.
        result = run_month(roster, sheet, users, out, "2024-01", clock, documents=True)
    return result


def report_text(result, owner):
    folder = f"{result.path('reports')}/manager_id={owner}"
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return "".join(open(f"{folder}/{p}").read() for p in parts)


def test_month_summary_and_issues(spark, month):
    scores = {r.manager_id: (r.compliance_score, r.risk_level) for r in month.table(spark, "summary").collect()}
    assert scores == {"m1": (50.0, "HIGH"), "m2": (100.0, "LOW"), "m3": (0.0, "HIGH")}
    found = {tuple(r)[1:] for r in month.table(spark, "issues").collect()}
    assert found == {("MISSING_IN_GETS", "m1", "2"), ("UNKNOWN_EMPLOYEE", "m1", "4"), ("UNKNOWN_EMPLOYEE", "m3", "8")}
    workbook = spark.read.option("header", True).csv(month.path("workbook") + "/summary").first()
    assert tuple(workbook) == ("1", "2", "0")


def test_month_report_text(month):
    assert report_text(month, "m1").splitlines() == [
        "== Roster compliance report", "Manager: Ann", "Generated: 2024-01-31 12:00:00", "Score: 50.0%", "Risk: HIGH",
        "== Counts", "On the roster: 2", "On the sheet: 2", "Matched: 1", "Missing: 1", "Unknown: 1", "Without e-mail: 1",
        "== Departments", "Ops: 2",
        "== Recommendations", "* Check the roster IDs that the sheet leaves out.",
        "* Trace the sheet IDs that no roster entry explains.", "* Fill in the company e-mail addresses that are blank.",
        "== Matched IDs", "1", "== IDs missing from the sheet", "2", "== Sheet IDs not on the roster", "4",
        "== Roster entries without e-mail", "2", "== End of report",
    ]
    assert "Score: 0%" in report_text(month, "m3")


def test_month_messages_and_documents(spark, month):
    mails = {r.receiver: r.body for r in month.table(spark, "notifications").collect()}
    assert set(mails) == {"ann@x", "bob@x"} and "Report: report_m1_20240131_120000.txt" in mails["ann@x"]
    docs = {r.manager_id: r for r in spark.read.json(month.path("documents")).collect()}
    entries = {(r.manager_id, r["list"], r.value) for r in month.table(spark, "document_entries").collect()}
    assert [v for m, kind, v in entries if (m, kind) == ("m1", "UNKNOWN")] == ["4"]
    assert docs["m2"].recommendations == ["NO_ISSUES"]
    raw = [json.loads(line) for f in os.listdir(month.path("documents")) if f.startswith("part-")
           for line in open(f"{month.path('documents')}/{f}")]
    assert {d["manager_id"] for d in raw} == {"m1", "m2", "m3"}


def test_long_report_is_written_by_several_tasks_in_order(spark, tmp_path):
    n = 20_000
    roster = spark.range(n).select(
        F.lit("hot").alias("manager_id"), F.format_string("%06d", "id").alias("employee_id"),
        F.lit("x@y").alias("company_email"), F.lit("Ops").alias("department"),
    )
    sheet = roster.select("manager_id", "employee_id")
    lines = reports.report_lines(
        reconcile.summarise(roster, sheet), spark.createDataFrame([], "manager_id string, name string"),
        reconcile.department_headcount_by_owner(roster), reconcile.reconcile(roster, sheet), reconcile.without_email(roster),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_reports(lines, f"{tmp_path}/r")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    folder = f"{tmp_path}/r/manager_id=hot"
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    text = "".join(open(f"{folder}/{p}").read() for p in parts).splitlines()
    assert len(parts) > 1
    start = text.index("== Matched IDs")
    assert text[start + 1 : start + 1 + n] == [f"{i:06d}" for i in range(n)]
    assert text[1] == "Manager: hot" and text[-1] == "== End of report"


def test_roster_files_are_imported_and_recorded(spark, tmp_path):
    inbox, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write(f"{inbox}/a.csv", "Employee ID,Employee Name,Department\n 1,Ann,Ops\n2,Bob,\n2,Bo,Dev\n,Nil,\n")
    write(f"{inbox}/b.csv", "Name,Emp ID,Email\nBobby,2,b@x\nCat,3,c@x\nOld,9,\n")
    write(f"{inbox}/copy.csv", "Employee ID,Employee Name,Department\n 1,Ann,Ops\n2,Bob,\n2,Bo,Dev\n,Nil,\n")
    write(f"{inbox}/bad.csv", "Badge\n1\n")
    write(f"{inbox}/seen.csv", "Employee ID\n77\n")
    write(f"{inbox}/plan.pdf", "x")
    os.utime(f"{inbox}/b.csv", (1e9, 1e9))
    os.utime(f"{inbox}/a.csv", (1e9 + 1, 1e9 + 1))
    owner = F.when(F.col("filename") == "b.csv", "m2").otherwise("m1")
    files = inventory.read_files(spark, inbox).withColumns({"manager_id": owner, "uploaded_by": F.concat(owner, F.lit("@x"))})
    roster = spark.createDataFrame([("9",)], "employee_id string")
    history = spark.createDataFrame([(hashlib.sha256(b"Employee ID\n77\n").hexdigest(),)], "file_hash string")
    clock = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    for _ in range(2):
        counts = import_roster_files(files, roster, history, out, "1", clock)
    assert {tuple(r) for r in counts.collect()} == {("m1", 1, 2, 1), ("m2", 2, 1, 0)}
    new = {(r.employee_id, r.full_name, r.company_email, r.manager_id) for r in spark.read.parquet(f"{out}/roster_rows").collect()}
    assert new == {("1", "Ann", None, "m1"), ("2", "Bobby", "b@x", "m2"), ("3", "Cat", "c@x", "m2")}
    verdicts = {r.filename: r.verdict for r in spark.read.parquet(f"{out}/inventory").collect()}
    assert verdicts == {
        "a.csv": "NEW", "b.csv": "NEW", "copy.csv": "REPEATED_IN_BATCH", "bad.csv": "NEW", "seen.csv": "IN_HISTORY",
        "plan.pdf": "BAD_EXTENSION",
    }
    uploads = spark.read.parquet(f"{out}/upload_history")
    assert {(r.filename, r.status, r.uploaded_by) for r in uploads.collect()} == {
        ("a.csv", "UPLOADED", "m1@x"), ("b.csv", "UPLOADED", "m2@x"), ("bad.csv", "FAILED", "m1@x")
    }
