"""Applying batches of changes to tables that are only ever appended to or rewritten."""

from pyspark.sql import Column, DataFrame, functions as F

from musterline import constants as K


def apply_changes(
    base: DataFrame, changes: DataFrame, key: str, order: list[str], columns: list[str]
) -> DataFrame:
    """``base`` with ``columns`` replaced by the newest change per key.

    Changes are reduced to one per key before they meet ``base``.  A change may set a null;
    changes that hit no base row are dropped.
    """
    newest = (
        changes.groupBy(key)
        .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_new"))
    )
    hit = F.col("_new").isNotNull()
    return base.join(newest, key, "left").select(
        *[
            F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in base.columns
        ]
    )


def assignment_outcome(has_manager: Column, has_hr: Column) -> Column:
    return F.when(~has_manager, "NO_SUCH_MANAGER").when(~has_hr, "NOT_HR").otherwise("OK")


def validate_assignments(assignments: DataFrame, users: DataFrame) -> DataFrame:
    """Each ``(hr_id, manager_id)`` pair with its ``outcome``; the manager is checked first."""

    def holders(role: str, key: str, flag: str) -> DataFrame:
        return users.where(F.col("role") == role).select(F.col("id").alias(key), F.lit(True).alias(flag))

    return (
        assignments.join(holders(K.ROLE_MANAGER, "manager_id", "_manager"), "manager_id", "left")
        .join(holders(K.ROLE_HR, "hr_id", "_hr"), "hr_id", "left")
        .select(
            *assignments.columns,
            assignment_outcome(F.col("_manager").isNotNull(), F.col("_hr").isNotNull()).alias("outcome"),
        )
    )


def assign_managers(users: DataFrame, assignments: DataFrame, order: str = "seq") -> DataFrame:
    """Users with ``manager_id`` set by the newest valid assignment of each HR user."""
    valid = validate_assignments(assignments, users).where(F.col("outcome") == "OK")
    return apply_changes(
        users, valid.select(F.col("hr_id").alias("id"), "manager_id", order), "id", [order], ["manager_id"]
    )


def decide_requests(
    decisions: DataFrame, requests: DataFrame, users: DataFrame, order: str = "request_id"
) -> DataFrame:
    """Outcome per decision: ``UNKNOWN_REQUEST``, ``USER_EXISTS``, ``APPROVED`` or ``REJECTED``.

    ``order`` is a column of ``decisions`` that is unique and says which came first.
    Approving creates an account, so of several approvals for one e-mail only the first
    succeeds.  That winner is found by grouping and comes back by ``order``, so a much
    repeated e-mail does not pile up in a join.
    """
    known = requests.select(
        F.col("id").alias("request_id"), "email", F.lit(True).alias("_known")
    )
    looked_up = decisions.join(known, "request_id", "left")
    winners = (
        looked_up.where(F.col("_known") & (F.col("decision") == "APPROVE"))
        .groupBy("email")
        .agg(F.min(order).alias(order))
        .join(users.select("email"), "email", "left_anti")
        .select(order, F.lit(True).alias("_wins"))
    )
    return looked_up.join(winners, order, "left").select(
        *decisions.columns,
        "email",
        F.when(F.col("_known").isNull(), "UNKNOWN_REQUEST")
        .when(F.col("decision") == "REJECT", K.REQUEST_REJECTED)
        .when(F.col("_wins"), K.REQUEST_APPROVED)
        .otherwise("USER_EXISTS")
        .alias("outcome"),
    )


def apply_decisions(requests: DataFrame, outcomes: DataFrame, order: str = "request_id") -> DataFrame:
    """Requests with ``status`` taken from the newest approval or rejection."""
    settled = outcomes.where(F.col("outcome").isin(K.REQUEST_APPROVED, K.REQUEST_REJECTED)).select(
        F.col("request_id").alias("id"), F.col(order).alias("_order"), F.col("outcome").alias("status")
    )
    return apply_changes(requests, settled, "id", ["_order"], ["status"])
