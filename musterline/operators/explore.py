"""Search, sorting and paging over the roster; search across entities."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from musterline import constants as K
from musterline.functions import contains_any
from musterline.operators.access import roster_scope

SEARCH_COLUMNS = ("employee_id", "full_name", "company_email", "department")
PAGE_COLUMNS = (
    "employee_id", "full_name", "company_email", "personal_email", "department", "customer",
    "manager", "manager_id", "created_at",
)


def search_roster(roster: DataFrame, text: str, literal: bool = False) -> DataFrame:
    return roster.where(contains_any(SEARCH_COLUMNS, text, literal)) if text else roster


def filter_roster(
    roster: DataFrame, search: str = "", department: str = "", literal: bool = False
) -> DataFrame:
    """Search and department filter, each skipped when its argument is empty."""
    found = search_roster(roster, search, literal)
    return found.where(F.col("department") == department) if department else found


def _checked(page: int, limit: int) -> None:
    if page < 1 or limit < 1:
        raise ValueError(f"page and limit start at 1, got page={page} limit={limit}")


def order_keys(columns: list[str], sort_by: str = "employee_id", sort_order: str = "asc") -> list[tuple[str, bool]]:
    """``(column, descending)`` to sort by: the chosen column, then ID, owner and row key, those there are."""
    column = sort_by if sort_by in (*K.SORTABLE_COLUMNS, "id") and sort_by in columns else "employee_id"
    ties = [c for c in ("employee_id", "manager_id", "id") if c != column and c in columns]
    return [(column, sort_order.lower() == "desc"), *[(c, False) for c in ties]]


def roster_order(columns: list[str], sort_by: str = "employee_id", sort_order: str = "asc") -> list[Column]:
    """Nulls last ascending, first descending.  With a unique ``id`` in the frame pages never overlap."""
    return [
        F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_last()
        for c, descending in order_keys(columns, sort_by, sort_order)
    ]


def _behind(column: str, descending: bool, value) -> Column:
    """Rows that come after ``value`` by one key."""
    if descending:
        return F.col(column).isNotNull() if value is None else F.col(column) < F.lit(value)
    return F.lit(False) if value is None else F.col(column).isNull() | (F.col(column) > F.lit(value))


def roster_page(
    roster: DataFrame,
    page: int = 1,
    limit: int = K.PAGE_SIZE,
    search: str = "",
    department: str = "",
    sort_by: str = "employee_id",
    sort_order: str = "asc",
    literal: bool = False,
) -> DataFrame:
    """One page in order.  Each task keeps ``page * limit`` rows; for deep pages use
    :func:`roster_page_after`."""
    _checked(page, limit)
    columns = [c for c in ("id", *PAGE_COLUMNS) if c in roster.columns]
    return (
        filter_roster(roster, search, department, literal)
        .select(*columns)
        .orderBy(*roster_order(columns, sort_by, sort_order))
        .offset((page - 1) * limit)
        .limit(limit)
    )


def my_roster_page(
    roster: DataFrame, role: str, user_id: str, manager_id: str | None = None, **page
) -> DataFrame:
    """The page as one user sees it: scope, search, department, sort, cut."""
    return roster_page(roster.where(roster_scope(role, user_id, manager_id)), **page)


def roster_page_after(
    roster: DataFrame,
    last: Mapping[str, object] | None,
    limit: int = K.PAGE_SIZE,
    search: str = "",
    department: str = "",
    sort_by: str = "employee_id",
    sort_order: str = "asc",
    literal: bool = False,
) -> DataFrame:
    """The page behind the row ``last`` (its values by name) in any order of :func:`roster_page`.

    Its cost does not grow with depth: each task keeps ``limit`` rows.  The walk reaches every
    row, nulls in their place, where ``id`` or all sort keys together are unique.
    """
    _checked(1, limit)
    rows = filter_roster(roster, search, department, literal)
    columns = [c for c in ("id", *PAGE_COLUMNS) if c in roster.columns]
    if last is not None:
        behind, equal = F.lit(False), F.lit(True)
        for column, descending in order_keys(columns, sort_by, sort_order):
            behind = behind | (equal & _behind(column, descending, last[column]))
            equal = equal & F.col(column).eqNullSafe(F.lit(last[column]))
        rows = rows.where(behind)
    return rows.select(*columns).orderBy(*roster_order(columns, sort_by, sort_order)).limit(limit)


def roster_page_info(
    roster: DataFrame,
    page: int = 1,
    limit: int = K.PAGE_SIZE,
    search: str = "",
    department: str = "",
    literal: bool = False,
) -> DataFrame:
    """``page, limit, total_records, total_pages``."""
    _checked(page, limit)
    return filter_roster(roster, search, department, literal).agg(
        F.lit(page).cast("long").alias("page"),
        F.lit(limit).cast("long").alias("page_limit"),
        F.count("*").alias("total_records"),
        F.ceil(F.count("*") / F.lit(limit)).cast("long").alias("total_pages"),
    )


def global_search(
    text: str,
    roster: DataFrame,
    users: DataFrame,
    uploads: DataFrame,
    reports: DataFrame,
    hits: int = K.SEARCH_HITS,
    literal: bool = False,
) -> DataFrame:
    """Up to ``hits`` rows from each entity, as ``(section, key, title, extra)``.

    Each section takes its own first hits in key order, so every task hands on at most
    ``hits`` rows and no section is shuffled whole.
    """

    def section(name: str, df: DataFrame, within: tuple, key: str, title: str, extra: str) -> DataFrame:
        return (
            df.where(contains_any(within, text, literal))
            .select(
                F.lit(name).alias("section"),
                F.col(key).cast("string").alias("key"),
                F.col(title).alias("title"),
                F.col(extra).cast("string").alias("extra"),
            )
            .orderBy(F.col("key").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("extra").asc_nulls_last())
            .limit(hits)
        )

    return (
        section("employees", roster, SEARCH_COLUMNS, "employee_id", "full_name", "department")
        .unionByName(section("users", users, ("name", "email"), "email", "name", "role"))
        .unionByName(section("uploads", uploads, ("filename",), "filename", "category", "uploaded_by"))
        .unionByName(section("reports", reports, ("filename",), "filename", "manager_email", "generated_at"))
    )
