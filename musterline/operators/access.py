"""Who may do and see what."""

from pyspark.sql import Column, DataFrame, functions as F

from musterline import constants as K


def effective_permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """``(user_id, role, permission, allowed)`` for every user and role flag.

    A missing role row or a null flag denies; HR is denied the fixed list whatever the
    flags say.  The roles table is a few rows: Spark broadcasts it by its measured size.
    """
    flags = [c for c in roles.columns if c in K.PERMISSION_FLAGS]
    joined = users.select(F.col("id").alias("user_id"), "role").join(
        roles.select(F.col("role_name").alias("role"), *flags), "role", "left"
    )
    is_hr = F.col("role") == K.ROLE_HR
    granted = [
        F.struct(
            F.lit(flag).alias("permission"),
            (F.coalesce(F.col(flag), F.lit(False)) & ~(is_hr & F.lit(flag in K.HR_DENIED))).alias("allowed"),
        )
        for flag in flags
    ]
    return joined.select("user_id", "role", F.inline(F.array(*granted)))


def roster_scope(role: str, user_id: str, manager_id: str | None, legacy_null_scope: bool = False) -> Column:
    """Filter for the roster rows one user may see; raises for a role that may see none.

    An HR user without a manager sees nothing, unless ``legacy_null_scope`` asks for the
    older rule by which they see every unassigned row.
    """
    if role == K.ROLE_ADMIN:
        return F.lit(True)
    if role == K.ROLE_MANAGER:
        return F.col("manager_id") == str(user_id)
    if role == K.ROLE_HR:
        if manager_id is None and not legacy_null_scope:
            return F.lit(False)
        return F.col("manager_id").eqNullSafe(F.lit(manager_id))
    raise PermissionError(f"role {role!r} has no roster access")


def upload_scope(role: str, email: str, manager_email: str | None) -> Column:
    """Filter for the uploads one user may see: own, the manager's, or all."""
    if role == K.ROLE_ADMIN:
        return F.lit(True)
    if role == K.ROLE_MANAGER:
        return F.col("uploaded_by") == email
    if role == K.ROLE_HR and manager_email is not None:
        return F.col("uploaded_by") == manager_email
    return F.lit(False)


def report_scope(role: str, email: str) -> Column:
    """Filter for report history: managers see their own, everyone else all."""
    return F.col("manager_email") == email if role == K.ROLE_MANAGER else F.lit(True)


def _with_total(per_key: DataFrame, key: str, *measures: Column) -> DataFrame:
    """Reduced rows per key, in scopes ``own`` / ``unassigned``, plus their total in scope ``all``, in one pass."""
    whole = [F.col(key), F.col("_null")]
    rolled = per_key.withColumn("_null", F.col(key).isNull()).groupingSets([whole, []], *whole).agg(
        F.grouping_id().alias("_level"), *measures
    )
    return rolled.select(
        F.when(F.col("_level") > 0, "all").when(F.col("_null"), "unassigned").otherwise("own").alias("scope"),
        F.coalesce(key, F.lit("")).alias("scope_key"),
        *[c for c in rolled.columns if c not in (key, "_null", "_level")],
    )


def scoped_roster_counts(users: DataFrame, roster: DataFrame, legacy_null_scope: bool = False) -> DataFrame:
    """Roster rows each user may see.

    The roster is counted per manager first, so users meet one row per manager instead of
    every user of a manager meeting every roster row.
    """
    per_manager = roster.groupBy("manager_id").agg(F.count("*").alias("visible"))
    counts = _with_total(per_manager, "manager_id", F.sum("visible").alias("visible"))
    role, boss = F.col("role"), F.col("manager_id")
    unassigned = F.lit("unassigned" if legacy_null_scope else "none")
    scoped = users.select(
        F.col("id").alias("user_id"),
        role,
        F.when(role == K.ROLE_ADMIN, "all")
        .when(role == K.ROLE_MANAGER, "own")
        .when((role == K.ROLE_HR) & boss.isNotNull(), "own")
        .when(role == K.ROLE_HR, unassigned)
        .otherwise("none")
        .alias("scope"),
        F.when(role == K.ROLE_MANAGER, F.col("id"))
        .when((role == K.ROLE_HR) & boss.isNotNull(), boss)
        .otherwise("")
        .alias("scope_key"),
    )
    return scoped.join(counts, ["scope", "scope_key"], "left").select(
        "user_id", "role", F.coalesce("visible", F.lit(0)).alias("visible_rows")
    )


def scoped_uploads(users: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploads each user may see: how many of each category, and the latest file.

    HR users see their manager's uploads.  Uploads are reduced per uploader before users
    are matched, so nothing grows with (users of a manager) x (uploads of that manager).
    """
    per_owner = uploads.groupBy(F.col("uploaded_by").alias("owner")).agg(*_upload_measures())
    counts = _with_total(
        per_owner, "owner",
        F.sum("roster_files").alias("roster_files"), F.sum("sheet_files").alias("sheet_files"), F.max("latest").alias("latest"),
    )
    bosses = users.select(F.col("id").alias("manager_id"), F.col("email").alias("manager_email"))
    role = F.col("role")
    scoped = users.join(bosses, "manager_id", "left").select(
        F.col("id").alias("user_id"),
        role,
        F.when(role == K.ROLE_ADMIN, "all").otherwise("own").alias("scope"),
        F.when(role == K.ROLE_ADMIN, "")
        .when(role == K.ROLE_MANAGER, F.col("email"))
        .when(role == K.ROLE_HR, F.col("manager_email"))
        .alias("scope_key"),
    )
    return scoped.join(counts, ["scope", "scope_key"], "left").select(
        "user_id",
        "role",
        F.coalesce("roster_files", F.lit(0)).alias("roster_files"),
        F.coalesce("sheet_files", F.lit(0)).alias("sheet_files"),
        F.col("latest.filename").alias("latest_file"),
    )


def _upload_measures() -> list[Column]:
    return [
        F.count_if(F.col("category") == K.ROSTER_FILE).alias("roster_files"),
        F.count_if(F.col("category") == K.SHEET_FILE).alias("sheet_files"),
        F.max(F.struct("created_at", "id", "filename")).alias("latest"),
    ]
