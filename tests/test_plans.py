"""What no plan may contain, and what the core plan must look like."""

import pytest

import __spark_entry__ as contract
from musterline.operators import reconcile
from musterline.plans import catalog, standins as V

QUERIES = catalog.queries()
UNWANTED = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_no_python_and_pruned_scans(spark, data_dir, name):
    plan = plan_of(QUERIES[name](spark, data_dir))
    assert not [word for word in UNWANTED if word in plan]
    assert "FileScan parquet" in plan


def test_no_window_runs_over_one_unpartitioned_group(spark, data_dir):
    for name, query in QUERIES.items():
        lines = plan_of(query(spark, data_dir)).splitlines()
        for i, line in enumerate(lines):
            if "Window [" in line:
                assert not any("SinglePartition" in below for below in lines[i : i + 5]), name


def test_core_comparison_shuffles_pairs_once_and_joins_nothing(spark, data_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        roster = V.roster(spark, data_dir)
        sheet = V.incoming_roster(spark, data_dir).select("manager_id", "employee_id")
        plan = plan_of(reconcile.summarise(roster, sheet))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan and "SortAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 2
    # Columns nobody counts are not read.
    assert "c_name" not in plan and "c_mktsegment" not in plan


def test_documents_collect_no_lists(spark, data_dir):
    for name in ("result_documents", "result_entries"):
        assert "collect_list" not in plan_of(QUERIES[name](spark, data_dir)), name


def test_set_operations_compare_once(spark, data_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("ids_intersect", "ids_except"):
            # One aggregation of pairs (partial and final), behind the join that makes the sheet.
            assert plan_of(QUERIES[name](spark, data_dir)).count("HashAggregate") == 2, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paging_and_recent_lists_keep_k_rows_per_task(spark, data_dir):
    for name in ("roster_page", "recent_uploads", "dataset_preview", "global_search"):
        assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, data_dir)), name
    for name in ("recent_uploads_per_manager", "recent_reports_per_manager", "import_new_rows", "batch_preview"):
        assert "Partial" in plan_of(QUERIES[name](spark, data_dir)), name


def test_filters_reach_the_scan(spark, data_dir):
    plan = plan_of(QUERIES["recent_uploads_per_manager"](spark, data_dir))
    assert "PushedFilters: [In(event_type" in plan


def test_entry_has_one_row_per_manager(spark):
    df = contract.entry(spark)
    assert df.columns == [
        "manager_id", "roster_count", "sheet_count", "matched", "missing", "unknown", "missing_email",
        "compliance_score", "risk_level",
    ]
    rows = df.collect()
    assert len(rows) == 25
    levels = [r.risk_level for r in rows]
    assert (levels.count("LOW"), levels.count("MEDIUM"), levels.count("HIGH")) == (7, 10, 8)
    assert (sum(r.matched for r in rows), sum(r.missing for r in rows), sum(r.unknown for r in rows)) == (125, 25, 48)
    boundary = next(r for r in rows if r.manager_id == "24")
    assert (boundary.compliance_score, boundary.risk_level) == (80.0, "MEDIUM")
