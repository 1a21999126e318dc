import datetime as dt

import pytest
from pyspark.sql import functions as F

from musterline.operators import access, changes, dashboards, explore, ingest


def test_import_first_row_wins_and_ids_are_checked_across_managers(spark):
    roster = spark.createDataFrame([("m1", "1"), ("m2", "2 ")], "manager_id string, employee_id string")
    batch = spark.createDataFrame([
        (1, " 2", "m1"), (2, "3", "m1"), (3, "3\t", "m2"), (4, "", "m1"), (5, None, "m2"), (6, "4", "m2"),
    ], "row_no long, employee_id string, manager_id string")
    rows = {(r.employee_id, r.manager_id, r.row_no) for r in ingest.import_new_rows(batch, roster).collect()}
    assert rows == {("3", "m1", 2), ("4", "m2", 6)}
    counts = {r.manager_id: (r.inserted, r.skipped, r.blank_ids) for r in ingest.import_counts(batch, roster).collect()}
    assert counts == {"m1": (1, 1, 1), "m2": (1, 1, 1)}


def test_duplicate_files(spark):
    files = spark.createDataFrame(
        [(1, "h1"), (2, "h1"), (3, "h2"), (4, "h3"), (5, "h2")], "n long, file_hash string"
    )
    history = spark.createDataFrame([("h2",), ("h2",), (None,)], "file_hash string")
    verdicts = {r.n: r.verdict for r in ingest.duplicate_verdicts(files, history, "n", ["n"]).collect()}
    assert verdicts == {1: "NEW", 2: "REPEATED_IN_BATCH", 3: "IN_HISTORY", 4: "NEW", 5: "REPEATED_IN_BATCH"}
    assert {r.n for r in ingest.new_files(files, history, "n").collect()} == {1, 4}


def test_admission_reports_the_first_failing_rule(spark):
    limit = 50 * 1024 * 1024
    files = spark.createDataFrame([
        ("a.pdf", "application/pdf", limit + 1), ("a.XLSX", "text/plain", limit + 1), ("a.csv", None, 1),
        ("a.csv", "text/csv", limit + 1), ("a.csv", "text/csv", limit),
    ], "filename string, content_type string, size_bytes long")
    assert [r.verdict for r in ingest.admit(files).collect()] == [
        "BAD_EXTENSION", "BAD_CONTENT_TYPE", "BAD_CONTENT_TYPE", "TOO_LARGE", "ACCEPTED"
    ]


def test_rename_headers_applies_synonyms_first_column_wins(spark):
    df = spark.createDataFrame([("1", "2", "n", "x", "l")], [" Emp ID ", "associate id", "NAME", "Badge.No", "Site Leave"])
    renamed = ingest.rename_headers(df, {"site leave": "internal_leave"})
    assert renamed.columns == ["employee_id", "associate id", "employee_name", "Badge.No", "internal_leave"]
    assert renamed.first().employee_id == "1"


def test_apply_changes_newest_wins_and_may_set_null(spark):
    base = spark.createDataFrame([(1, "a", "k"), (2, "b", "k"), (3, "c", "k")], "id long, v string, w string")
    delta = spark.createDataFrame([(1, "x", 1), (1, None, 2), (2, "y", 1), (9, "z", 1)], "id long, v string, seq long")
    rows = {r.id: (r.v, r.w) for r in changes.apply_changes(base, delta, "id", ["seq"], ["v"]).collect()}
    assert rows == {1: (None, "k"), 2: ("y", "k"), 3: ("c", "k")}


USERS = "id string, name string, email string, role string, manager_id string"


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([
        ("a", "A", "a@x", "MASTER_ADMIN", None), ("m1", "M1", "m1@x", "MANAGER", None),
        ("m2", "M2", "m2@x", "MANAGER", None), ("h1", "H1", "h1@x", "HR", "m1"), ("h2", "H2", "h2@x", "HR", None),
        ("v", "V", "v@x", "VISITOR", "m1"),
    ], USERS)


def test_assignments(spark, users):
    asked = spark.createDataFrame(
        [(1, "h1", "m2"), (2, "h1", "m1"), (3, "h2", "m2"), (4, "m1", "m2"), (5, "h2", "h1"), (6, "zz", "zz")],
        "seq long, hr_id string, manager_id string",
    )
    outcome = {r.seq: r.outcome for r in changes.validate_assignments(asked, users).collect()}
    assert outcome == {1: "OK", 2: "OK", 3: "OK", 4: "NOT_HR", 5: "NO_SUCH_MANAGER", 6: "NO_SUCH_MANAGER"}
    after = {r.id: r.manager_id for r in changes.assign_managers(users, asked).collect()}
    assert after == {"a": None, "m1": None, "m2": None, "h1": "m1", "h2": "m2", "v": "m1"}


def test_request_decisions(spark, users):
    requests = spark.createDataFrame(
        [(1, "new@x", "PENDING"), (2, "new@x", "PENDING"), (3, "m1@x", "PENDING"), (4, "other@x", "PENDING"), (5, None, "PENDING")],
        "id long, email string, status string",
    )
    decided = spark.createDataFrame(
        [(1, "APPROVE"), (2, "APPROVE"), (3, "APPROVE"), (4, "REJECT"), (7, "REJECT")], "request_id long, decision string"
    )
    outcomes = changes.decide_requests(decided, requests, users)
    assert {r.request_id: r.outcome for r in outcomes.collect()} == {
        1: "APPROVED", 2: "USER_EXISTS", 3: "USER_EXISTS", 4: "REJECTED", 7: "UNKNOWN_REQUEST"
    }
    after = {r.id: r.status for r in changes.apply_decisions(requests, outcomes).collect()}
    assert after == {1: "APPROVED", 2: "PENDING", 3: "PENDING", 4: "REJECTED", 5: "PENDING"}


def test_later_decision_on_the_same_request_wins(spark, users):
    requests = spark.createDataFrame([(1, "new@x", "PENDING")], "id long, email string, status string")
    decided = spark.createDataFrame(
        [(1, 1, "APPROVE"), (2, 1, "APPROVE"), (3, 1, "REJECT")], "seq long, request_id long, decision string"
    )
    outcomes = changes.decide_requests(decided, requests, users, order="seq")
    assert [r.outcome for r in outcomes.orderBy("seq").collect()] == ["APPROVED", "USER_EXISTS", "REJECTED"]
    assert changes.apply_decisions(requests, outcomes, order="seq").first().status == "REJECTED"


def test_permissions_deny_by_default_and_hr_is_read_only(spark, users):
    roles = spark.createDataFrame(
        [("MANAGER", True, None, True), ("HR", True, True, True)],
        "role_name string, can_compare boolean, can_manage_users boolean, can_view_reports boolean",
    )
    rows = {(r.user_id, r.permission): r.allowed for r in access.effective_permissions(users, roles).collect()}
    assert len(rows) == 18
    assert rows[("m1", "can_compare")] and not rows[("m1", "can_manage_users")]
    assert not rows[("h1", "can_compare")] and rows[("h1", "can_view_reports")]
    assert not rows[("a", "can_compare")] and not rows[("v", "can_view_reports")]


@pytest.fixture(scope="module")
def owned(spark):
    return spark.createDataFrame([("m1", "1"), ("m1", "2"), ("m2", "3"), (None, "4")], "manager_id string, employee_id string")


def test_scoped_roster_counts(users, owned):
    def counts(**options):
        return {r.user_id: r.visible_rows for r in access.scoped_roster_counts(users, owned, **options).collect()}

    assert counts() == {"a": 4, "m1": 2, "m2": 1, "h1": 2, "h2": 0, "v": 0}
    assert counts(legacy_null_scope=True)["h2"] == 1


def test_roster_scope_of_one_user(owned):
    def seen(*args, **options):
        return owned.where(access.roster_scope(*args, **options)).count()

    assert [seen("MASTER_ADMIN", "a", None), seen("MANAGER", "m1", None), seen("HR", "h1", "m1")] == [4, 2, 2]
    assert [seen("HR", "h2", None), seen("HR", "h2", None, legacy_null_scope=True)] == [0, 1]
    with pytest.raises(PermissionError):
        access.roster_scope("VISITOR", "v", "m1")


def test_scoped_uploads(spark, users):
    at = dt.datetime(2024, 1, 1)
    uploads = spark.createDataFrame([
        (1, "f1", "EMPLOYEE_DATA", "m1@x", at), (2, "f2", "GETS_SHEET", "m1@x", at), (3, "f3", "GETS_SHEET", "m2@x", at),
    ], "id long, filename string, category string, uploaded_by string, created_at timestamp_ntz")
    rows = {r.user_id: tuple(r)[2:] for r in access.scoped_uploads(users, uploads).collect()}
    assert rows == {
        "a": (1, 2, "f3"), "m1": (1, 1, "f2"), "m2": (0, 1, "f3"), "h1": (1, 1, "f2"), "h2": (0, 0, None), "v": (0, 0, None)
    }
    assert uploads.where(access.upload_scope("HR", "h1@x", "m1@x")).count() == 2
    assert uploads.where(access.upload_scope("HR", "h2@x", None)).count() == 0


PEOPLE = "employee_id string, full_name string, company_email string, department string, manager_id string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([
        (f"e{i:02d}", f"Name {i}", None, [None, "Ops", "Dev"][i % 3], "m") for i in range(25)
    ], PEOPLE)


def ids(df):
    return [r.employee_id for r in df.collect()]


def test_pages_cover_the_roster_once(people):
    pages = [ids(explore.roster_page(people, p, 10, sort_by="department", sort_order="DESC")) for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [10, 10, 5, 0]
    assert len({i for p in pages for i in p}) == 25
    first = explore.roster_page(people, 1, 10, sort_by="department", sort_order="desc").collect()
    assert [r.department for r in first] == [None] * 9 + ["Ops"]
    ascending = explore.roster_page(people, 3, 10, sort_by="department").collect()
    assert [r.department for r in ascending] == [None] * 5
    assert ids(explore.roster_page(people, 1, 3, sort_by="no such column", sort_order="x")) == ["e00", "e01", "e02"]


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("sort_by", ["employee_id", "full_name", "department", "manager_id"])
def test_keyset_pages_equal_offset_pages(spark, sort_by, order):
    rows = spark.createDataFrame(
        [(f"k{i:02d}", None if i % 3 else f"e{i % 6}", f"n{i % 4}", None if i % 5 == 0 else f"d{i % 2}", None if i % 7 == 0 else f"m{i % 3}")
         for i in range(30)],
        "id string, employee_id string, full_name string, department string, manager_id string",
    ).coalesce(2)
    whole = [r.id for r in explore.roster_page(rows, 1, 100, sort_by=sort_by, sort_order=order).collect()]
    last, seen = None, []
    while page := explore.roster_page_after(rows, last, 11, sort_by=sort_by, sort_order=order).collect():
        seen += [r.id for r in page]
        last = page[-1].asDict()
    assert seen == whole and sorted(seen) == [f"k{i:02d}" for i in range(30)]


def test_page_filters_and_info(people):
    found = explore.roster_page(people, 1, 50, search="NAME 1", department="Ops")
    assert ids(found) == ["e01", "e10", "e13", "e16", "e19"]
    info = explore.roster_page_info(people, 1, 10, search="name 1").first()
    assert (info.total_records, info.total_pages) == (11, 2)
    assert explore.roster_page_info(people.limit(0)).first().total_pages == 0


def test_my_page_is_scoped(people):
    def size(*who):
        return explore.my_roster_page(people, *who, limit=50).count()

    assert [size("MANAGER", "m"), size("MANAGER", "x"), size("HR", "h", "m"), size("HR", "h"), size("MASTER_ADMIN", "a")] == [25, 0, 25, 0, 25]


@pytest.mark.parametrize("page,limit", [(0, 10), (1, 0), (-1, 5)])
def test_bad_pages_are_refused(people, page, limit):
    with pytest.raises(ValueError):
        explore.roster_page(people, page, limit)


def test_latest_report_ignores_never_downloaded_rows(spark, users):
    at = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    reports = spark.createDataFrame([
        (1, "m1", "m1@x", "r1", at[0], "m1@x", at[1]), (2, "m1", "m1@x", "r2", at[1], "m1@x", None),
        (3, "m1", "m1@x", "r3", at[2], None, None), (4, "m1", "m1@x", "r4", at[3], "m2@x", at[3]),
    ], "id long, manager_id string, manager_email string, filename string, generated_at timestamp_ntz, downloaded_by string, downloaded_at timestamp_ntz")
    uploads = spark.createDataFrame([], "uploaded_by string, category string")
    audit = spark.createDataFrame([("m1@x", "RUN_COMPARISON"), ("m1@x", "OTHER")], "user_email string, action string")
    roster = spark.createDataFrame([("m1",)], "manager_id string")
    rows = {r.manager_id: r for r in dashboards.manager_dashboard(users, roster, uploads, audit, reports).collect()}
    m1 = rows["m1"]
    assert (m1.hr_count, m1.headcount, m1.comparisons, m1.reports_generated, m1.reports_downloaded, m1.latest_report) == (
        1, 1, 1, 4, 2, "r1"
    )
    assert (rows["m2"].reports_generated, rows["m2"].latest_report, rows["m2"].total_uploads) == (0, "r4", 0)
    hr = {r.hr_id: r for r in dashboards.hr_dashboard(users, roster, uploads, reports).collect()}
    assert hr["h1"].recent_reports == "r1,r2" and hr["h2"].manager_id is None
    assert (hr["h2"].headcount, hr["h2"].recent_reports) == (0, "")


def test_weekday_trend_flags_failed_sheets(spark):
    monday = dt.datetime(2024, 1, 1)
    uploads = spark.createDataFrame([
        ("GETS_SHEET", "COMPLETED", monday), ("GETS_SHEET", "FAILED", monday), ("EMPLOYEE_DATA", "UPLOADED", monday),
    ], "category string, status string, created_at timestamp_ntz")
    assert [tuple(r) for r in dashboards.weekday_trend(uploads).collect()] == [("Mon", 1, 0, 1)]


def test_job_status_is_the_newest(spark):
    at = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    rows = spark.createDataFrame([
        (1, "f", "PROCESSING", "u", at[0]), (2, "f", "COMPLETED", "u", at[1]), (3, "g", "FAILED", "u", at[0]), (4, "g", "X", "u", None),
        (5, "h", "OLD", "u", None), (6, "h", "NEW", "u", None),
    ], "id long, filename string, status string, uploaded_by string, created_at timestamp_ntz")
    assert {r.filename: r.status for r in dashboards.job_status(rows).collect()} == {"f": "COMPLETED", "g": "FAILED", "h": "NEW"}


def test_top_rows_are_cut_before_the_shuffle(spark):
    from musterline.operators.ranking import top_per_group

    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    plan = top_per_group(df, ["g"], [F.col("id").desc()], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
