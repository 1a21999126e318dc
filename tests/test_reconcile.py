import random

import pytest
from pyspark.sql import functions as F

from musterline.operators import reconcile as R
from musterline.operators import reports

ROSTER = "manager_id string, employee_id string, company_email string, department string"


def roster_of(spark, rows):
    return spark.createDataFrame(rows, ROSTER)


def sheet_of(spark, rows):
    return spark.createDataFrame(rows, "manager_id string, employee_id string")


@pytest.fixture(scope="module")
def small(spark):
    roster = roster_of(spark, [
        ("a", "1", "x@y", "Ops"), ("a", "2\t", " ", ""), ("a", None, None, None), ("a", "3", "x@y", " "),
        ("b", "9", "x@y", "Ops"), (None, "5", "x@y", "Ops"),
    ])
    sheet = sheet_of(spark, [
        ("a", " 1\xa0"), ("a", "1"), ("a", "2"), ("a", "9"), ("a", ""), ("a", None),
        ("c", "7"), ("d", " "), (None, "5"),
    ])
    return roster, sheet


def by_manager(df):
    return {r["manager_id"]: r.asDict() for r in df.collect()}


def test_summary(small):
    rows = by_manager(R.summarise(*small))
    assert set(rows) == {"a", "b", "c", "d"}
    assert rows["a"] == {
        "manager_id": "a", "roster_count": 3, "sheet_count": 3, "matched": 2, "missing": 1, "unknown": 1,
        "missing_email": 2, "compliance_score": 66.67, "risk_level": "HIGH",
    }
    # No sheet, no roster, and nothing but a blank on the sheet.
    assert (rows["b"]["missing"], rows["b"]["compliance_score"]) == (1, 0.0)
    assert (rows["c"]["roster_count"], rows["c"]["unknown"], rows["c"]["compliance_score"], rows["c"]["risk_level"]) == (0, 1, 0.0, "HIGH")
    assert (rows["d"]["sheet_count"], rows["d"]["risk_level"]) == (0, "HIGH")


def test_id_of_another_manager_is_unknown(small):
    rows = {(r.manager_id, r.employee_id): r.status for r in R.reconcile(*small).collect()}
    assert rows == {
        ("a", "1"): "MATCHED", ("a", "2"): "MATCHED", ("a", "3"): "MISSING", ("a", "9"): "UNKNOWN",
        ("b", "9"): "MISSING", ("c", "7"): "UNKNOWN",
    }


def test_details_join_agrees_with_the_single_grouping(small):
    roster, sheet = small
    wide = R.reconcile_with_details(roster, sheet, ("department",))
    narrow = {tuple(r) for r in R.reconcile(roster, sheet).collect()}
    assert {tuple(r)[:3] for r in wide.collect()} == narrow
    found = {(r.manager_id, r.employee_id): r.department for r in wide.collect()}
    assert found[("a", "3")] == " " and found[("a", "9")] is None


def test_without_email_lists_rows_with_no_id_too(small):
    rows = {tuple(r) for r in R.without_email(small[0]).collect()}
    assert rows == {("a", "2"), ("a", None)}


def test_id_quality_accounts_for_dropped_ids(small):
    rows = {(r.manager_id, r.side): (r.row_count, r.blank_ids) for r in R.id_quality(*small).collect()}
    assert rows[("a", "ROSTER")] == (4, 1) and rows[("a", "SHEET")] == (6, 2) and rows[("d", "SHEET")] == (1, 1)


def test_departments_count_every_row_and_score_ids(small):
    heads = {(r.manager_id, r.department): r.headcount for r in R.department_headcount_by_owner(small[0]).collect()}
    assert heads == {("a", "Ops"): 1, ("a", "Unknown"): 2, ("a", " "): 1, ("b", "Ops"): 1}
    scores = {(r.manager_id, r.department): r.compliance_score for r in R.department_compliance(*small).collect()}
    assert scores == {("a", "Ops"): 100.0, ("a", "Unknown"): 100.0, ("a", " "): 0.0, ("b", "Ops"): 0.0}


def test_rollup_recomputes_the_score(small):
    rows = by_manager(R.organization_rollup(R.summarise(*small)))
    total = rows["ALL"]
    assert (total["roster_count"], total["matched"], total["compliance_score"]) == (4, 2, 50.0)


def test_issues_and_optional_leave_mismatch(spark):
    leave = "manager_id string, employee_id string, customer_leave string, internal_leave string"
    roster = spark.createDataFrame([
        ("a", "same", "1", None), ("a", "differs", "1", "2"), ("a", "gone", "1", "2"),
        ("a", "null_vs_value", None, "2"), ("a", "one_copy_differs", "1", "1"),
    ], leave).withColumn("company_email", F.lit("x"))
    sheet = spark.createDataFrame([
        ("a", "same ", "1", None), ("a", "same", "1", None), ("a", "differs", "1", "3"),
        ("a", "null_vs_value", "0", "2"), ("a", "new", "1", "1"),
        ("a", "one_copy_differs", "1", "1"), ("a", "one_copy_differs", "1", "9"),
    ], leave)
    found = R.issues(R.reconcile(roster, sheet), roster, sheet)
    assert {(r.issue_type, r.employee_id) for r in found.collect()} == {
        ("MISSING_IN_GETS", "gone"), ("UNKNOWN_EMPLOYEE", "new"), ("LEAVE_MISMATCH", "differs"),
        ("LEAVE_MISMATCH", "null_vs_value"), ("LEAVE_MISMATCH", "one_copy_differs"),
    }
    assert R.issue_count_row(found).first().asDict() == {
        "missing_in_gets": 1, "unknown_employee": 1, "leave_mismatch": 3
    }
    plain = R.issues(R.reconcile(roster, sheet.drop("customer_leave")), roster, sheet.drop("customer_leave"))
    assert plain.where("issue_type = 'LEAVE_MISMATCH'").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_set_laws_on_random_inputs(spark, seed):
    rng = random.Random(seed)
    pads = ["", " ", "\t", " "]

    def draw(n):
        return [(rng.choice("abc"), rng.choice(pads) + str(rng.randrange(40)) + rng.choice(pads)) for _ in range(n)]

    left, right = draw(rng.randrange(80)), draw(rng.randrange(80))
    roster = roster_of(spark, [(m, e, None, None) for m, e in left])
    sheet = sheet_of(spark, right)
    a, b = ({(m, e.strip()) for m, e in side} for side in (left, right))

    status = {(r.manager_id, r.employee_id): r.status for r in R.reconcile(roster, sheet).collect()}
    assert status == {p: "MATCHED" if p in a & b else "MISSING" if p in a else "UNKNOWN" for p in a | b}
    for m, row in by_manager(R.summarise(roster, sheet)).items():
        mine, theirs = ({p for p in s if p[0] == m} for s in (a, b))
        assert row["matched"] + row["missing"] == row["roster_count"] == len(mine)
        assert row["matched"] + row["unknown"] == row["sheet_count"] == len(theirs)
        assert row["compliance_score"] == (round(len(mine & theirs) / len(mine) * 100, 2) if mine else 0)

    twice = R.reconcile(roster, sheet.unionByName(sheet)).exceptAll(R.reconcile(roster, sheet))
    assert twice.count() == 0
    swapped = R.reconcile(sheet.withColumn("company_email", F.lit(None).cast("string")), roster)
    flip = {"MATCHED": "MATCHED", "MISSING": "UNKNOWN", "UNKNOWN": "MISSING"}
    assert {(r.manager_id, r.employee_id): flip[r.status] for r in swapped.collect()} == status


def frames(roster, sheet):
    return (
        R.summarise(roster, sheet), R.department_headcount_by_owner(roster),
        R.reconcile(roster, sheet), R.without_email(roster),
    )


def test_result_has_one_head_and_a_row_per_entry(small):
    summary, departments, pairs, no_email = frames(*small)
    heads = {r.manager_id: r for r in reports.result_documents(summary).collect()}
    assert heads["a"].summary.matched == 2
    assert heads["a"].recommendations == ["REVIEW_MISSING", "VERIFY_UNKNOWN", "FIX_EMAIL"]
    entries = reports.result_entries(departments, pairs, no_email).where("manager_id = 'a'")
    assert {(r["list"], r["value"], r["n"]) for r in entries.collect()} == {
        ("MATCHED", "1", 1), ("MATCHED", "2", 1), ("MISSING", "3", 1), ("UNKNOWN", "9", 1), ("NO_EMAIL", "2", 1), ("NO_EMAIL", None, 1),
        ("DEPARTMENT", "Unknown", 2), ("DEPARTMENT", " ", 1), ("DEPARTMENT", "Ops", 1),
    }

