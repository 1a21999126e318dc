"""Comparing a roster with uploaded sheets, for every manager in one job.

Both sides are reduced to tagged ``(manager, ID)`` pairs, concatenated and grouped once.
Copies collapse before the shuffle (partial aggregation over fixed-width flags), the
shuffle key carries the ID, so a manager owning a third of all rows still spreads over
every partition, and no join is needed to find out who is on which side.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from musterline import constants as K
from musterline.functions import (
    clean_id,
    department_or_unknown,
    email_missing,
    recommendation_codes,
    risk_level,
    score,
)
from musterline.sources.buckets import Buckets, open_buckets


def presence(roster: DataFrame, sheet: DataFrame, by: str = "manager_id") -> DataFrame:
    """One row per ``(by, employee_id)`` with ``in_roster``, ``in_sheet`` and ``no_email``.

    ``no_email`` counts roster rows without an e-mail.  Rows whose ID is blank meet in one
    null-ID row per owner; they count for e-mails but belong to no ID set.
    Rows without an owner are left out: nobody compares them.
    """
    on_roster = roster.select(
        by,
        clean_id("employee_id").alias("employee_id"),
        F.lit(True).alias("in_roster"),
        F.lit(False).alias("in_sheet"),
        email_missing("company_email").cast("long").alias("no_email"),
    )
    on_sheet = sheet.select(
        by,
        clean_id("employee_id").alias("employee_id"),
        F.lit(False).alias("in_roster"),
        F.lit(True).alias("in_sheet"),
        F.lit(0).cast("long").alias("no_email"),
    )
    return (
        on_roster.unionByName(on_sheet)
        .where(F.col(by).isNotNull())
        .groupBy(by, "employee_id")
        .agg(
            F.bool_or("in_roster").alias("in_roster"),
            F.bool_or("in_sheet").alias("in_sheet"),
            F.sum("no_email").alias("no_email"),
        )
    )


def match_status() -> Column:
    return (
        F.when(F.col("in_roster") & F.col("in_sheet"), K.MATCHED)
        .when(F.col("in_roster"), K.MISSING)
        .otherwise(K.UNKNOWN)
    )


def statuses(present: DataFrame, by: str = "manager_id") -> DataFrame:
    """``(by, employee_id, status)`` from :func:`presence` rows."""
    return present.where(F.col("employee_id").isNotNull()).select(
        by, "employee_id", match_status().alias("status")
    )


def reconcile(roster: DataFrame, sheet: DataFrame, by: str = "manager_id") -> DataFrame:
    """``(by, employee_id, status)``: one row per ID found on either side."""
    return statuses(presence(roster, sheet, by), by)


def roster_details(roster: DataFrame, columns: tuple, by: str = "manager_id") -> DataFrame:
    """One row per ``(by, employee_id)``; of several copies the smallest details are kept."""
    return (
        roster.select(by, clean_id("employee_id").alias("employee_id"), F.struct(*columns).alias("d"))
        .where(F.col(by).isNotNull() & F.col("employee_id").isNotNull())
        .groupBy(by, "employee_id")
        .agg(F.min("d").alias("d"))
        .select(by, "employee_id", "d.*")
    )


def reconcile_with_details(
    roster: DataFrame,
    sheet: DataFrame,
    columns: tuple = ("full_name", "company_email", "department"),
    by: str = "manager_id",
) -> DataFrame:
    """As :func:`reconcile`, with roster columns alongside (null for unknown IDs).

    Details have to travel with the roster here, so the two sides are joined: each is
    unique on the join key and already partitioned by it, and is shuffled once.
    """
    details = roster_details(roster, columns, by).withColumn("_r", F.lit(True))
    seen = id_set(sheet, by).withColumn("_s", F.lit(True))
    found = details.join(seen, [by, "employee_id"], "full_outer")
    in_roster, in_sheet = (F.coalesce(c, F.lit(False)) for c in ("_r", "_s"))
    return found.withColumns({"in_roster": in_roster, "in_sheet": in_sheet}).select(
        by, "employee_id", match_status().alias("status"), *columns
    )


def reconcile_buckets(roster: Buckets, sheet: Buckets, columns: tuple = ("full_name", "company_email", "department")) -> DataFrame:
    """As :func:`reconcile_with_details` over stored buckets: no exchange while their numbers are equal.

    IDs are clean in stored tables.  Each side is reduced to one row per pair within its
    buckets; the join then finds both sides where they lie.
    """
    spark, by = SparkSession.active(), roster.by
    details = (
        open_buckets(spark, roster).groupBy(by, "employee_id").agg(F.min(F.struct(*columns)).alias("_d")).withColumn("_r", F.lit(True))
    )
    seen = open_buckets(spark, sheet).select(F.col(sheet.by).alias(by), "employee_id").distinct().withColumn("_s", F.lit(True))
    found = details.join(seen, [by, "employee_id"], "full_outer")
    in_roster, in_sheet = (F.coalesce(c, F.lit(False)) for c in ("_r", "_s"))
    return found.withColumns({"in_roster": in_roster, "in_sheet": in_sheet}).select(
        by, "employee_id", match_status().alias("status"), *[F.col(f"_d.{c}").alias(c) for c in columns]
    )


def ids_with_status(reconciliation: DataFrame, status: str, by: str = "manager_id") -> DataFrame:
    return reconciliation.where(F.col("status") == status).select(by, "employee_id")


def id_set(df: DataFrame, by: str = "manager_id") -> DataFrame:
    """Distinct cleaned ``(by, employee_id)`` pairs."""
    return (
        df.select(by, clean_id("employee_id").alias("employee_id"))
        .where(F.col(by).isNotNull() & F.col("employee_id").isNotNull())
        .distinct()
    )


def ids_on_both(roster: DataFrame, sheet: DataFrame, by: str = "manager_id") -> DataFrame:
    return presence(roster, sheet, by).where("in_roster and in_sheet").select(by, "employee_id")


def ids_on_one(roster: DataFrame, sheet: DataFrame, by: str = "manager_id") -> DataFrame:
    """Both set differences, told apart by ``side``."""
    return presence(roster, sheet, by).where("in_roster <> in_sheet").select(
        by, "employee_id", F.when(F.col("in_roster"), "ROSTER_ONLY").otherwise("SHEET_ONLY").alias("side")
    )


def without_email(roster: DataFrame, by: str = "manager_id") -> DataFrame:
    """Roster rows with a null or blank e-mail (a null ID stays listed)."""
    return roster.where(F.col(by).isNotNull() & email_missing("company_email")).select(
        by, clean_id("employee_id").alias("employee_id")
    )


def id_quality(roster: DataFrame, sheet: DataFrame, by: str = "manager_id") -> DataFrame:
    """Rows and blank IDs per owner on each side, so that dropped IDs are accounted for."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            by, F.lit(name).alias("side"), clean_id("employee_id").isNull().alias("blank")
        )

    return (
        side(roster, "ROSTER").unionByName(side(sheet, "SHEET"))
        .groupBy(by, "side")
        .agg(F.count("*").alias("row_count"), F.count_if("blank").alias("blank_ids"))
    )


def _counts(listed: Column) -> list[Column]:
    r, s = F.col("in_roster"), F.col("in_sheet")
    return [
        F.count_if(listed & r).alias("roster_count"),
        F.count_if(listed & s).alias("sheet_count"),
        F.count_if(listed & r & s).alias("matched"),
        F.count_if(listed & r & ~s).alias("missing"),
        F.count_if(listed & s & ~r).alias("unknown"),
    ]


def with_score(counts: DataFrame) -> DataFrame:
    scored = counts.withColumn("compliance_score", score(F.col("matched"), F.col("roster_count")))
    return scored.withColumn("risk_level", risk_level(F.col("compliance_score")))


def summarise_presence(present: DataFrame, by: str = "manager_id") -> DataFrame:
    listed = F.col("employee_id").isNotNull()
    return with_score(
        present.groupBy(by).agg(*_counts(listed), F.sum("no_email").alias("missing_email"))
    )


def summarise(roster: DataFrame, sheet: DataFrame, by: str = "manager_id") -> DataFrame:
    """Six counts, score and risk per owner found in the roster or the sheet.

    One pass over each input: the grouping by pair feeds the grouping by owner, whose
    partial counts are all that is shuffled the second time.
    """
    return summarise_presence(presence(roster, sheet, by), by)


def department_headcount_by_owner(roster: DataFrame, by: str = "manager_id") -> DataFrame:
    return (
        roster.where(F.col(by).isNotNull())
        .groupBy(by, department_or_unknown("department").alias("department"))
        .agg(F.count("*").alias("headcount"))
    )


def department_compliance(roster: DataFrame, sheet: DataFrame, by: str = "manager_id") -> DataFrame:
    """Score per owner and department; unknown IDs have no department and stay out."""
    placed = roster_details(
        roster.withColumn("department", department_or_unknown("department")), ("department",), by
    )
    seen = id_set(sheet, by).withColumn("in_sheet", F.lit(True))
    counts = (
        placed.join(seen, [by, "employee_id"], "left")
        .groupBy(by, "department")
        .agg(F.count("*").alias("roster_count"), F.count("in_sheet").alias("matched"))
        .withColumn("missing", F.col("roster_count") - F.col("matched"))
    )
    return with_score(counts)


def recommendations(summary: DataFrame, by: str = "manager_id") -> DataFrame:
    """Recommendation codes per owner, in fixed order."""
    return summary.select(
        by, recommendation_codes(F.col("missing"), F.col("unknown"), F.col("missing_email")).alias("codes")
    )


def organization_rollup(summary: DataFrame, by: str = "manager_id", total: str = "ALL") -> DataFrame:
    """Owner rows plus one grand-total row, its score recomputed from the summed counts."""
    counts = ("roster_count", "sheet_count", "matched", "missing", "unknown", "missing_email")
    rolled = (
        summary.rollup(by)
        .agg(*[F.sum(c).alias(c) for c in counts], F.grouping(by).alias("_total"))
        .withColumn(by, F.when(F.col("_total") == 1, total).otherwise(F.col(by)))
        .drop("_total")
    )
    return with_score(rolled)


def issues(
    reconciliation: DataFrame,
    roster: DataFrame | None = None,
    sheet: DataFrame | None = None,
    by: str = "manager_id",
) -> DataFrame:
    """``(issue_order, issue_type, by, employee_id)`` for every ID needing attention.

    The leave mismatch type is added where roster and sheet are given and both carry the
    two leave columns.
    """
    names = K.ISSUE_TYPES
    found = reconciliation.where(F.col("status") != K.MATCHED).select(
        F.when(F.col("status") == K.MISSING, 1).otherwise(2).alias("issue_order"),
        F.when(F.col("status") == K.MISSING, names[0]).otherwise(names[1]).alias("issue_type"),
        by,
        "employee_id",
    )
    if roster is None or sheet is None:
        return found
    if not all(c in df.columns for df in (roster, sheet) for c in K.LEAVE_COLUMNS):
        return found
    mismatched = leave_mismatches(roster, sheet, by).select(
        F.lit(3).alias("issue_order"), F.lit(names[2]).alias("issue_type"), by, "employee_id"
    )
    return found.unionByName(mismatched)


def leave_mismatches(roster: DataFrame, sheet: DataFrame, by: str = "manager_id") -> DataFrame:
    """IDs on both sides whose leave figures differ in some row (null equals null).

    Every distinct pair of figures seen for an ID is tagged with the sides it occurs on and
    each side's variety is counted, so no row is ever paired with another.
    """

    def figures(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            by, clean_id("employee_id").alias("employee_id"), *K.LEAVE_COLUMNS,
            F.lit(side == "roster").alias("in_roster"), F.lit(side == "sheet").alias("in_sheet"),
        ).where(F.col(by).isNotNull() & F.col("employee_id").isNotNull())

    variants = (
        figures(roster, "roster").unionByName(figures(sheet, "sheet"))
        .groupBy(by, "employee_id", *K.LEAVE_COLUMNS)
        .agg(F.bool_or("in_roster").alias("in_roster"), F.bool_or("in_sheet").alias("in_sheet"))
    )
    return (
        variants.groupBy(by, "employee_id")
        .agg(
            F.bool_or("in_roster").alias("in_roster"),
            F.bool_or("in_sheet").alias("in_sheet"),
            F.count("*").alias("figures"),
        )
        .where(F.col("in_roster") & F.col("in_sheet") & (F.col("figures") > 1))
        .select(by, "employee_id")
    )


def issue_counts(issue_rows: DataFrame) -> DataFrame:
    return issue_rows.groupBy("issue_order", "issue_type").agg(F.count("*").alias("issue_count"))


def issue_count_row(issue_rows: DataFrame) -> DataFrame:
    """The one-row form: a column per issue type, zero where none was found."""
    return issue_rows.agg(
        *[F.count_if(F.col("issue_type") == t).alias(t.lower()) for t in K.ISSUE_TYPES]
    )

