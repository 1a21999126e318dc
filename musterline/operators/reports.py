"""Report lines, messages and result documents, built from already reconciled frames."""

from pyspark.sql import Column, DataFrame, functions as F

from musterline import constants as K
from musterline.operators.numbering import copies, numbered
from musterline.functions import (
    advice_text,
    executive_codes,
    recommendation_codes,
    score_text,
    timestamp_suffix,
)

# --- fixed values: report sections and count captions, in order of appearance ----------
SECTION_TITLES = (
    (1, "== Roster compliance report"),
    (2, "== Counts"),
    (3, "== Departments"),
    (4, "== Recommendations"),
    (5, "== Matched IDs"),
    (6, "== IDs missing from the sheet"),
    (7, "== Sheet IDs not on the roster"),
    (8, "== Roster entries without e-mail"),
    (9, "== End of report"),
)
COUNT_CAPTIONS = (
    ("roster_count", "On the roster"),
    ("sheet_count", "On the sheet"),
    ("matched", "Matched"),
    ("missing", "Missing"),
    ("unknown", "Unknown"),
    ("missing_email", "Without e-mail"),
)
_STATUS_SECTION = {K.MATCHED: 5, K.MISSING: 6, K.UNKNOWN: 7}


def _codes() -> Column:
    return recommendation_codes(F.col("missing"), F.col("unknown"), F.col("missing_email"))


def _score_text() -> Column:
    return score_text(F.col("compliance_score"), F.col("roster_count"))


def report_name(owner: Column, clock: Column) -> Column:
    return F.concat(F.lit("report_"), owner, F.lit("_"), timestamp_suffix(clock), F.lit(".txt"))


def executive_summary(summary: DataFrame, by: str = "manager_id") -> DataFrame:
    """Priority, one sentence, and counted recommendation codes per owner."""
    return summary.select(
        by,
        F.col("risk_level").alias("priority"),
        "risk_level",
        F.concat(
            F.lit("Verified "), F.col("matched").cast("string"), F.lit(" out of "),
            F.col("roster_count").cast("string"), F.lit(" roster IDs: score "), _score_text(),
            F.lit("%, risk "), F.col("risk_level"), F.lit("."),
        ).alias("summary_text"),
        executive_codes(
            F.col("missing"), F.col("unknown"), F.col("missing_email"), F.col("compliance_score")
        ).alias("codes"),
    )


def report_lines(
    summary: DataFrame,
    names: DataFrame,
    departments: DataFrame,
    reconciliation: DataFrame,
    no_email: DataFrame,
    generated: Column | None = None,
    by: str = "manager_id",
) -> DataFrame:
    """``(by, section_no, line_key, line)``: the whole text report of every owner.

    Reading order is ``section_no, line_key, line``; :func:`numbered_lines` numbers them.
    """
    most = _lines(summary, names, departments, reconciliation, generated, by)
    return most.unionByName(_no_email_lines(no_email, by))


def _no_email_lines(no_email: DataFrame, by: str) -> DataFrame:
    shown_id = F.coalesce("employee_id", F.lit("(no ID)"))
    return no_email.select(by, F.lit(8).alias("section_no"), shown_id.alias("line_key"), shown_id.alias("line"))


def numbered_lines(
    summary: DataFrame,
    names: DataFrame,
    departments: DataFrame,
    reconciliation: DataFrame,
    no_email: DataFrame,
    generated: Column | None = None,
    by: str = "manager_id",
) -> DataFrame:
    """As :func:`report_lines` with ``line_no``, from 1 and without gaps for each owner.

    Numbers are prefix sums over range partitions, so an owner's report may be longer than any
    task.  Roster rows without e-mail may share an ID; such lines are counted first and told apart by
    copy, so they spread like all others.
    """
    most = _lines(summary, names, departments, reconciliation, generated, by).withColumn("_copy", F.lit(1).cast("long"))
    gaps = _no_email_lines(no_email, by)
    repeated = copies(gaps.groupBy(*gaps.columns).agg(F.count("*").alias("_n")), "_n", "_copy").drop("_n")
    return numbered(most.unionByName(repeated), [by], ["section_no", "line_key", "line", "_copy"], "line_no").drop("_copy")


def _lines(
    summary: DataFrame, names: DataFrame, departments: DataFrame, reconciliation: DataFrame, generated: Column | None, by: str
) -> DataFrame:
    """Every line but those of roster rows without e-mail."""

    def line(section: int, key, text: Column) -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        return F.struct(F.lit(section).alias("section_no"), key.alias("line_key"), text.alias("line"))

    fixed = [line(no, "", F.lit(title)) for no, title in SECTION_TITLES]
    fixed += [
        line(1, "1", F.concat(F.lit("Manager: "), F.coalesce("name", by))),
        line(1, "3", F.concat(F.lit("Score: "), _score_text(), F.lit("%"))),
        line(1, "4", F.concat(F.lit("Risk: "), F.col("risk_level"))),
    ]
    if generated is not None:
        fixed.append(line(1, "2", F.concat(F.lit("Generated: "), generated.cast("string"))))
    fixed += [
        line(2, str(i), F.concat(F.lit(caption + ": "), F.col(column).cast("string")))
        for i, (column, caption) in enumerate(COUNT_CAPTIONS, 1)
    ]
    advice = F.transform(_codes(), lambda code, i: line(4, (i + 1).cast("string"), F.concat(F.lit("* "), advice_text(code))))
    named = summary.join(names.select(by, "name"), by, "left")
    from_summary = named.select(by, F.inline(F.concat(F.array(*fixed), advice)))

    # Larger departments first: the key counts down.
    countdown = F.lpad((F.lit(10**15) - F.col("headcount")).cast("string"), 16, "0")
    from_departments = departments.select(
        by, F.lit(3).alias("section_no"),
        F.concat(countdown, F.lit(" "), F.col("department")).alias("line_key"),
        F.concat("department", F.lit(": "), F.col("headcount").cast("string")).alias("line"),
    )
    section = F.when(F.col("status") == K.MATCHED, _STATUS_SECTION[K.MATCHED])
    section = section.when(F.col("status") == K.MISSING, _STATUS_SECTION[K.MISSING]).otherwise(_STATUS_SECTION[K.UNKNOWN])
    from_ids = reconciliation.select(
        by, section.alias("section_no"), F.col("employee_id").alias("line_key"), F.col("employee_id").alias("line")
    )
    return from_summary.unionByName(from_departments).unionByName(from_ids)


def in_reading_order(lines: DataFrame, by: str = "manager_id") -> DataFrame:
    """Lines range-partitioned and sorted; a large owner spans several partitions in order."""
    keys = (by, "section_no", "line_key", "line")
    return lines.repartitionByRange(*keys).sortWithinPartitions(*keys)


def notifications(summary: DataFrame, users: DataFrame, report: Column) -> DataFrame:
    """``(receiver, subject, body)`` per summary row whose manager has an account.

    ``report`` names the report file; the messages are ready to hand to a mailer.
    """
    people = users.where(F.col("role") == K.ROLE_MANAGER).select(
        F.col("id").alias("manager_id"), "name", "email"
    )
    counts = [
        F.concat(F.lit(caption + ": "), F.col(column).cast("string")) for column, caption in COUNT_CAPTIONS
    ]
    advice = F.array_join(F.transform(_codes(), lambda code: F.concat(F.lit("* "), advice_text(code))), "\n")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Dear "), F.col("name"), F.lit(",")),
        F.lit("your sheet has been compared with the roster."),
        F.concat(F.lit("Score: "), _score_text(), F.lit("%")),
        F.concat(F.lit("Risk: "), F.col("risk_level")),
        *counts,
        advice,
        F.concat(F.lit("Report: "), report),
    )
    return summary.join(people, "manager_id").select(
        F.col("email").alias("receiver"),
        F.concat(F.lit("Your compliance report: risk "), F.col("risk_level")).alias("subject"),
        body.alias("body"),
    )


def result_documents(summary: DataFrame, by: str = "manager_id") -> DataFrame:
    """The head of each owner's result: its summary and recommendation codes.

    What an owner has many of is in :func:`result_entries`, so no row grows with the owner.
    """
    facts = [c for c in summary.columns if c != by]
    return summary.select(by, F.struct(*facts).alias("summary"), _codes().alias("recommendations"))


def result_entries(
    departments: DataFrame, reconciliation: DataFrame, no_email: DataFrame, by: str = "manager_id"
) -> DataFrame:
    """One row ``(owner, list, value, n)`` per entry of an owner's result.

    Lists: ``MATCHED``, ``MISSING``, ``UNKNOWN`` IDs; ``NO_EMAIL`` with the number of roster rows
    of that ID (null for rows without one); ``DEPARTMENT`` with its headcount.
    """
    one = F.lit(1).cast("long")
    gaps = no_email.groupBy(by, "employee_id").agg(F.count("*").alias("n"))
    return (
        reconciliation.select(by, F.col("status").alias("list"), F.col("employee_id").alias("value"), one.alias("n"))
        .unionByName(gaps.select(by, F.lit("NO_EMAIL").alias("list"), F.col("employee_id").alias("value"), "n"))
        .unionByName(departments.select(by, F.lit("DEPARTMENT").alias("list"), F.col("department").alias("value"), F.col("headcount").alias("n")))
    )
