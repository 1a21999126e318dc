"""The whole comparison for all managers, with every output written once.

The pair table is written first and read back: six outputs hang off it, none of them
recomputes it, and losing executors later costs a re-read instead of a re-shuffle.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from musterline import constants as K
from musterline.functions import utc_now
from musterline.operators import reconcile, reports
from musterline.sources import sinks


@dataclass(frozen=True)
class MonthlyResult:
    """Where one run put its tables; read them with :meth:`table`."""

    out: str
    run: str

    def path(self, name: str) -> str:
        return f"{self.out}/{name}/run={self.run}"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))


def run_month(
    roster: DataFrame,
    sheet: DataFrame,
    users: DataFrame,
    out: str,
    run: str,
    clock: Column | None = None,
    documents: bool = False,
) -> MonthlyResult:
    """Compare, summarise, list issues, write reports and messages for run ``run``.

    ``out`` must be storage that all executors share.  Running again with the same name
    replaces that run's outputs.
    """
    clock = utc_now() if clock is None else clock
    result = MonthlyResult(out, run)

    def publish(df: DataFrame, name: str) -> DataFrame:
        return sinks.publish(df, f"{out}/{name}", run=run)

    present = publish(reconcile.presence(roster, sheet), "pairs")
    summary = publish(reconcile.summarise_presence(present), "summary")
    departments = publish(reconcile.department_headcount_by_owner(roster), "departments")
    no_email = publish(reconcile.without_email(roster), "without_email")
    pairs = reconcile.statuses(present)
    found = publish(reconcile.issues(pairs, roster, sheet), "issues")

    publish(reconcile.recommendations(summary), "recommendations")
    publish(reports.executive_summary(summary), "executive_summary")
    publish(reconcile.organization_rollup(summary), "organization")
    names = users.where(F.col("role") == K.ROLE_MANAGER).select(F.col("id").alias("manager_id"), "name")
    sinks.write_reports(
        reports.report_lines(summary, names, departments, pairs, no_email, generated=clock),
        result.path("reports"),
    )
    sinks.write_issue_workbook(found, reconcile.issue_count_row(found), result.path("workbook"))
    publish(
        reports.notifications(summary, users, reports.report_name(F.col("manager_id"), clock)), "notifications"
    )
    if documents:
        sinks.write_documents(reports.result_documents(summary), result.path("documents"))
        publish(reports.result_entries(departments, pairs, no_email), "document_entries")
    return result
