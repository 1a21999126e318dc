"""The test tables seen as roster, sheet, user, history and file tables.

Each function takes ``(spark, sf_dir)`` and returns a lazily read DataFrame with the
column names the operators expect.
"""

from pyspark.sql import DataFrame, SparkSession

from musterline import constants as K

# --- fixed values: columns of the driver tables in use ------------------------------
_SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A declared schema saves the job that would read it from file footers."""
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) employee_id",
        "c_name full_name",
        """case when c_acctbal < 0 then null when c_custkey % 17 = 0 then ' '
           else 'c' || c_custkey || '@example.com' end company_email""",
        """case when c_custkey % 13 = 0 then null when c_custkey % 29 = 0 then ''
           else c_mktsegment end department""",
        "cast(c_nationkey as string) manager_id",
    )


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sheet rows, padded and repeated; a sixth of the customers always under another ID, missing and unknown at once."""
    orders = _read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return orders.join(_read(spark, sf_dir, "customer"), "c_custkey").selectExpr(
        "cast(c_nationkey as string) manager_id",
        """case when o_orderkey % 7 = 0 then ' ' else '' end
           || cast(case when c_custkey % 6 = 0 or o_orderkey % 50 = 0 then c_custkey + 1000000 else c_custkey end as string)
           || case when o_orderkey % 3 = 0 then ' ' else '' end employee_id""",
    )


def roster_with_leave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roster with the two leave figures, some of them absent."""
    return _read(spark, sf_dir, "customer").selectExpr(
        "cast(c_nationkey as string) manager_id",
        "cast(c_custkey as string) employee_id",
        "cast(c_custkey % 4 as string) customer_leave",
        "case when c_custkey % 6 <> 0 then cast(c_custkey % 3 as string) end internal_leave",
    )


def sheet_with_leave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet rows repeating the roster's figures, but for some orders."""
    orders = _read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return orders.join(_read(spark, sf_dir, "customer"), "c_custkey").selectExpr(
        "cast(c_nationkey as string) manager_id",
        "case when o_orderkey % 3 = 0 then ' ' else '' end || cast(c_custkey as string) employee_id",
        """case when o_orderkey % 7 = 0 then null else cast(c_custkey % 4 as string) end customer_leave""",
        """case when o_orderkey % 11 = 0 then '9'
           when c_custkey % 6 <> 0 then cast(c_custkey % 3 as string) end internal_leave""",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    managers = _read(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as string) id",
        "'Manager ' || n_nationkey name",
        "'user' || n_nationkey || '@example.com' email",
        "'MANAGER' role",
        "cast(null as string) manager_id",
    )
    hr = _read(spark, sf_dir, "supplier").selectExpr(
        "cast(1000 + s_suppkey as string) id",
        "s_name name",
        "'hr' || s_suppkey || '@example.com' email",
        "case when s_suppkey % 10 = 7 then 'MASTER_ADMIN' else 'HR' end role",
        "case when s_suppkey % 11 <> 0 then cast(s_nationkey as string) end manager_id",
    )
    return managers.unionByName(hr)


def upload_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").where("event_type in ('signup', 'view', 'error')").selectExpr(
        "event_id id",
        "'file_' || event_id || '.csv' filename",
        "sha2(event_type || user_id || props, 256) file_hash",
        "case when event_type = 'signup' then 'EMPLOYEE_DATA' else 'GETS_SHEET' end category",
        """case event_type when 'signup' then 'UPLOADED' when 'view' then 'COMPLETED'
           else case when event_id % 2 = 0 then 'FAILED' else 'PROCESSING' end end status""",
        "'user' || (user_id % 25) || '@example.com' uploaded_by",
        "ts created_at",
    )


def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr(
        "event_id id",
        "cast(user_id % 25 as string) manager_id",
        "'user' || (user_id % 25) || '@example.com' manager_email",
        "'report_' || event_id || '.txt' filename",
        "ts generated_at",
        "case when event_id % 3 <> 0 then 'user' || (user_id % 25) || '@example.com' end downloaded_by",
        "case when event_id % 3 <> 0 then ts + interval 1 hour end downloaded_at",
    )


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id id",
        "'user' || (user_id % 25) || '@example.com' user_email",
        "case event_type when 'click' then 'RUN_COMPARISON' else upper(event_type) end action",
        "props details",
        "ts created_at",
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What jobs tell of themselves: many starts and ends for each job, in any order."""
    return _read(spark, sf_dir, "events").where("event_type in ('view', 'purchase', 'error')").selectExpr(
        "event_id id",
        "'job_' || user_id job",
        "case event_type when 'view' then 'PROCESSING' when 'purchase' then 'COMPLETED' else 'FAILED' end status",
        "ts created_at",
    )


def user_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr(
        "event_id id", "'user' || user_id owner", "ts uploaded_at"
    )


def user_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that end uploads, each of them told twice."""
    ends = _read(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").selectExpr(
        "event_id id", "'user' || user_id owner",
        "case event_type when 'purchase' then 'COMPLETED' else 'FAILED' end status", "ts ended_at",
    )
    return ends.unionByName(ends)


def user_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey id",
        """case when o_custkey % 20 = 0 then 'hr' || (o_custkey % 10) || '@example.com'
           else 'c' || o_custkey || '@example.com' end email""",
        "case when o_orderkey % 2 = 0 then 'HR' else 'MANAGER' end requested_role",
        "case o_orderstatus when 'P' then 'PENDING' when 'F' then 'APPROVED' else 'REJECTED' end status",
        "o_orderdate created_at",
    )


def request_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "case when o_orderkey % 7 = 0 then -1 - o_orderkey else o_orderkey end request_id",
        "case when o_orderkey % 3 = 0 then 'REJECT' else 'APPROVE' end decision",
    )


def incoming_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey row_no",
        "cast(case when o_orderkey % 4 = 0 then o_custkey + 2000000 else o_custkey end as string) employee_id",
        "'Name ' || o_custkey full_name",
        "cast(o_orderkey % 25 as string) manager_id",
    )


def hr_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey seq",
        "case when s_suppkey % 9 = 0 then '0' else cast(1000 + s_suppkey as string) end hr_id",
        "cast(s_suppkey % 30 as string) manager_id",
    )


def report_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").where("event_type = 'click'").selectExpr(
        "event_id seq",
        "event_id - event_id % 4 report_id",
        "'user' || (user_id % 25) || '@example.com' downloaded_by",
        "ts downloaded_at",
    )


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inline table, so its exact size is known when a join is planned."""
    return spark.sql(f"""
        select * from values
          ('MASTER_ADMIN', {", ".join(["true"] * 12)}, cast(null as boolean)),
          ('MANAGER', true, true, true, false, true, false, true, true, true, true, false, cast(null as boolean), true),
          ('HR', false, true, true, true, true, false, true, false, true, true, true, false, true)
        as t(role_name, {", ".join(K.PERMISSION_FLAGS)})
    """)


def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows of the incoming files, one row per header, spelt differently per file."""
    return _read(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        r"""posexplode(array(
             case doc_id % 3 when 0 then ' Emp ID ' when 1 then 'EMPLOYEE ID' else 'associate id\t' end,
             case when doc_id % 2 = 0 then 'NAME' else 'Employee Name' end,
             case when doc_id % 5 = 0 then 'Email' else ' Company Email' end,
             'Department',
             initcap(source))) as (pos, header)""",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """source || '/' || lang || ' ' || doc_id
           || case doc_id % 7 when 0 then '.CSV' when 1 then '.xlsx' when 2 then '.xls' when 3 then '.pdf'
              when 4 then '.jpeg' when 5 then '' else '.csv' end filename""",
        "case when doc_id % 9 = 0 then 'text/plain' else 'text/csv' end content_type",
        "case when doc_id % 10 = 3 then n_chars + 60000000 else n_chars end size_bytes",
        "text content",
    )
