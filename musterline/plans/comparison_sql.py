"""ANSI SQL for every named query, to be run on the same tables by another engine.

The stand-in views are common table expressions; each statement includes those it uses.
"""

_VIEWS = {
    "roster": """
select cast(c_custkey as varchar) employee_id, c_name full_name,
 case when c_acctbal < 0 then null when c_custkey % 17 = 0 then ' '
      else 'c' || c_custkey || '@example.com' end company_email,
 case when c_custkey % 13 = 0 then null when c_custkey % 29 = 0 then '' else c_mktsegment end department,
 cast(c_nationkey as varchar) manager_id
from customer""",
    "sheet": """
select cast(c_nationkey as varchar) manager_id,
 case when o_orderkey % 7 = 0 then ' ' else '' end
 || cast(case when c_custkey % 6 = 0 or o_orderkey % 50 = 0 then o_custkey + 1000000 else o_custkey end as varchar)
 || case when o_orderkey % 3 = 0 then ' ' else '' end employee_id
from orders join customer on o_custkey = c_custkey""",
    "roster_with_leave": """
select cast(c_nationkey as varchar) manager_id, cast(c_custkey as varchar) employee_id,
 cast(c_custkey % 4 as varchar) customer_leave,
 case when c_custkey % 6 <> 0 then cast(c_custkey % 3 as varchar) end internal_leave
from customer""",
    "sheet_with_leave": """
select cast(c_nationkey as varchar) manager_id, cast(c_custkey as varchar) employee_id,
 case when o_orderkey % 7 = 0 then null else cast(c_custkey % 4 as varchar) end customer_leave,
 case when o_orderkey % 11 = 0 then '9'
      when c_custkey % 6 <> 0 then cast(c_custkey % 3 as varchar) end internal_leave
from orders join customer on o_custkey = c_custkey""",
    "users": """
select cast(n_nationkey as varchar) id, 'Manager ' || n_nationkey as name,
 'user' || n_nationkey || '@example.com' email, 'MANAGER' as role, cast(null as varchar) manager_id
from nation
union all
select cast(1000 + s_suppkey as varchar), s_name, 'hr' || s_suppkey || '@example.com',
 case when s_suppkey % 10 = 7 then 'MASTER_ADMIN' else 'HR' end,
 case when s_suppkey % 11 = 0 then null else cast(s_nationkey as varchar) end
from supplier""",
    "upload_history": """
select event_id id, 'file_' || event_id || '.csv' filename,
 sha256(event_type || user_id || props) file_hash,
 case when event_type = 'signup' then 'EMPLOYEE_DATA' else 'GETS_SHEET' end category,
 case event_type when 'signup' then 'UPLOADED' when 'view' then 'COMPLETED'
 else case when event_id % 2 = 0 then 'FAILED' else 'PROCESSING' end end status,
 'user' || (user_id % 25) || '@example.com' uploaded_by, ts created_at
from events where event_type in ('signup', 'view', 'error')""",
    "report_history": """
select event_id id, cast(user_id % 25 as varchar) manager_id,
 'user' || (user_id % 25) || '@example.com' manager_email, 'report_' || event_id || '.txt' filename,
 ts generated_at,
 case when event_id % 3 = 0 then null else 'user' || (user_id % 25) || '@example.com' end downloaded_by,
 case when event_id % 3 = 0 then null else ts + interval 1 hour end downloaded_at
from events where event_type = 'purchase'""",
    "audit_logs": """
select event_id id, 'user' || (user_id % 25) || '@example.com' user_email,
 case event_type when 'click' then 'RUN_COMPARISON' else upper(event_type) end as action,
 props details, ts created_at
from events""",
    "job_events": """
select event_id id, 'job_' || user_id job,
 case event_type when 'view' then 'PROCESSING' when 'purchase' then 'COMPLETED' else 'FAILED' end status, ts created_at
from events where event_type in ('view', 'purchase', 'error')""",
    "user_requests": """
select o_orderkey id,
 case when o_custkey % 20 = 0 then 'hr' || (o_custkey % 10) || '@example.com'
      else 'c' || o_custkey || '@example.com' end email,
 case when o_orderkey % 2 = 0 then 'HR' else 'MANAGER' end requested_role,
 case o_orderstatus when 'P' then 'PENDING' when 'F' then 'APPROVED' else 'REJECTED' end status,
 o_orderdate created_at
from orders""",
    "decisions": """
select case when o_orderkey % 7 = 0 then -1 - o_orderkey else o_orderkey end request_id,
 case when o_orderkey % 3 = 0 then 'REJECT' else 'APPROVE' end decision
from orders""",
    "incoming_roster": """
select o_orderkey row_no,
 cast(case when o_orderkey % 4 = 0 then o_custkey + 2000000 else o_custkey end as varchar) employee_id,
 'Name ' || o_custkey full_name, cast(o_orderkey % 25 as varchar) manager_id
from orders""",
    "hr_assignments": """
select s_suppkey seq, case when s_suppkey % 9 = 0 then '0' else cast(1000 + s_suppkey as varchar) end hr_id,
 cast(s_suppkey % 30 as varchar) manager_id
from supplier""",
    "report_downloads": """
select event_id seq, event_id - event_id % 4 report_id,
 'user' || (user_id % 25) || '@example.com' downloaded_by, ts downloaded_at
from events where event_type = 'click'""",
    "user_roles": """
select * from (values
 ('MASTER_ADMIN', true, true, true, true, true, true, true, true, true, true, true, true, cast(null as boolean)),
 ('MANAGER', true, true, true, false, true, false, true, true, true, true, false, cast(null as boolean), true),
 ('HR', false, true, true, true, true, false, true, false, true, true, true, false, true))
as t(role_name, can_upload, can_download, can_view_reports, can_generate_reports, can_receive_email, can_manage_users,
 can_upload_employee, can_upload_gets, can_compare, can_download_reports, can_create_roles, can_assign_manager,
 can_approve_requests)""",
    "files": """
select doc_id,
 source || '/' || lang || ' ' || doc_id
 || case doc_id % 7 when 0 then '.CSV' when 1 then '.xlsx' when 2 then '.xls' when 3 then '.pdf'
    when 4 then '.jpeg' when 5 then '' else '.csv' end filename,
 case when doc_id % 9 = 0 then 'text/plain' else 'text/csv' end content_type,
 case when doc_id % 10 = 3 then n_chars + 60000000 else n_chars end size_bytes, text as content
from documents""",
    "file_headers": """
select doc_id, 0 as pos,
 case doc_id % 3 when 0 then ' Emp ID ' when 1 then 'EMPLOYEE ID' else 'associate id' || chr(9) end header from documents
union all select doc_id, 1, case when doc_id % 2 = 0 then 'NAME' else 'Employee Name' end from documents
union all select doc_id, 2, case when doc_id % 5 = 0 then 'Email' else ' Company Email' end from documents
union all select doc_id, 3, 'Department' from documents
union all select doc_id, 4, upper(left(source, 1)) || lower(substr(source, 2)) from documents""",
    # Derived views.
    "roster_ids": "select distinct manager_id, trim(employee_id) employee_id from roster where trim(employee_id) <> ''",
    "sheet_ids": "select distinct manager_id, trim(employee_id) employee_id from sheet where trim(employee_id) <> ''",
    "pairs": """
select coalesce(r.manager_id, s.manager_id) manager_id, coalesce(r.employee_id, s.employee_id) employee_id,
 case when s.employee_id is null then 'MISSING' when r.employee_id is null then 'UNKNOWN' else 'MATCHED' end status
from roster_ids r full join sheet_ids s on r.manager_id = s.manager_id and r.employee_id = s.employee_id""",
    "mismatches": """
select distinct r.manager_id, trim(r.employee_id) employee_id
from roster_with_leave r join sheet_with_leave s on s.manager_id = r.manager_id and trim(s.employee_id) = r.employee_id
where r.customer_leave is distinct from s.customer_leave or r.internal_leave is distinct from s.internal_leave""",
    "issue_rows": """
select case status when 'MISSING' then 'MISSING_IN_GETS' else 'UNKNOWN_EMPLOYEE' end issue_type, manager_id, employee_id
from pairs where status <> 'MATCHED'
union all select 'LEAVE_MISMATCH', manager_id, employee_id from mismatches""",
    "no_email": """
select manager_id, trim(employee_id) employee_id from roster
where company_email is null or trim(company_email) = ''""",
    "counts": """
select p.manager_id,
 count(*) filter (where status <> 'UNKNOWN') roster_count,
 count(*) filter (where status <> 'MISSING') sheet_count,
 count(*) filter (where status = 'MATCHED') matched,
 count(*) filter (where status = 'MISSING') missing,
 count(*) filter (where status = 'UNKNOWN') as unknown,
 (select count(*) from no_email n where n.manager_id = p.manager_id) missing_email
from pairs p group by p.manager_id""",
    "scored": """
select *, case when roster_count = 0 then 0.0
 else cast(printf('%.2f', cast(matched as double) / cast(roster_count as double) * 100) as double) end compliance_score
from counts""",
    "summary": """
select *, case when compliance_score >= 95 then 'LOW' when compliance_score >= 80 then 'MEDIUM' else 'HIGH' end risk_level
from scored""",
    "departments": """
select manager_id, coalesce(nullif(department, ''), 'Unknown') department, count(*) headcount
from roster group by 1, 2""",
    "managers": "select id, name, email from users where role = 'MANAGER'",
    "upload_counts": """
select uploaded_by email, count(*) total_uploads,
 count(*) filter (where category = 'EMPLOYEE_DATA') roster_uploads,
 count(*) filter (where category = 'GETS_SHEET') sheet_uploads
from upload_history group by 1""",
    "headcounts": "select manager_id id, count(*) headcount from roster group by 1",
    "ranked_reports": """
select downloaded_by, row_number() over (partition by downloaded_by order by downloaded_at desc nulls last, id desc) as position,
 id, filename, downloaded_at
from report_history where downloaded_by is not null""",
    "first_new_rows": """
select * from (
 select *, row_number() over (partition by employee_id order by row_no) as nth from incoming_roster) b
where nth = 1 and employee_id not in (select employee_id from roster)""",
    "outcomes": """
select d.request_id, d.decision, r.email,
 case when r.id is null then 'UNKNOWN_REQUEST'
      when d.decision = 'REJECT' then 'REJECTED'
      when exists (select 1 from users u where u.email = r.email) then 'USER_EXISTS'
      when d.request_id = min(case when d.decision = 'APPROVE' then d.request_id end) over (partition by r.email) then 'APPROVED'
      else 'USER_EXISTS' end outcome
from decisions d left join user_requests r on r.id = d.request_id""",
    "assignment_outcomes": """
select a.seq, a.hr_id, a.manager_id,
 case when not exists (select 1 from users m where m.id = a.manager_id and m.role = 'MANAGER') then 'NO_SUCH_MANAGER'
      when not exists (select 1 from users h where h.id = a.hr_id and h.role = 'HR') then 'NOT_HR'
      else 'OK' end outcome
from hr_assignments a""",
    "file_extensions": """
select doc_id, case when filename like '%.%' then lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) else '' end extension
from files""",
}

# Which views a view reads, so that a statement carries only what it needs.
_USES = {
    "roster_ids": ("roster",), "sheet_ids": ("sheet",), "pairs": ("roster_ids", "sheet_ids"),
    "mismatches": ("roster_with_leave", "sheet_with_leave"), "issue_rows": ("pairs", "mismatches"),
    "no_email": ("roster",), "counts": ("pairs", "no_email"), "scored": ("counts",), "summary": ("scored",),
    "departments": ("roster",), "managers": ("users",), "upload_counts": ("upload_history",),
    "headcounts": ("roster",), "ranked_reports": ("report_history",),
    "first_new_rows": ("incoming_roster", "roster"), "outcomes": ("decisions", "user_requests", "users"),
    "assignment_outcomes": ("hr_assignments", "users"), "file_extensions": ("files",),
}


def _with(views: str, body: str) -> str:
    ordered: list[str] = []

    def add(view: str) -> None:
        for used in _USES.get(view, ()):
            add(used)
        if view not in ordered:
            ordered.append(view)

    for name in views.split():
        add(name)
    return "with " + ",\n".join(f"{v} as ({_VIEWS[v]})" for v in ordered) + "\n" + body.strip()


_ADVICE = """case when missing > 0 then '* Check the roster IDs that the sheet leaves out.' end,
 case when unknown > 0 then '* Trace the sheet IDs that no roster entry explains.' end,
 case when missing_email > 0 then '* Fill in the company e-mail addresses that are blank.' end,
 case when missing = 0 and unknown = 0 and missing_email = 0 then '* Nothing to follow up.' end"""

_DETAILED = """
select p.*, r.full_name, r.company_email, r.department
from pairs p left join roster r on r.manager_id = p.manager_id and r.employee_id = p.employee_id"""

_FOUND = """
select * from roster where employee_id ilike '%build%' or full_name ilike '%build%'
 or company_email ilike '%build%' or department ilike '%build%'"""

_STAMPED = """
select r.id, r.manager_id, r.manager_email, r.filename, r.generated_at,
 case when c.seq is not null then c.downloaded_by else r.downloaded_by end downloaded_by,
 case when c.seq is not null then c.downloaded_at else r.downloaded_at end downloaded_at
from report_history r left join (
 select *, row_number() over (partition by report_id order by seq desc) as nth from report_downloads) c
on c.report_id = r.id and c.nth = 1"""

_SCORE_TEXT = "case when roster_count = 0 then '0' else cast(compliance_score as varchar) end"

_SCORE = """case when roster_count = 0 then 0.0
 else cast(printf('%.2f', cast(matched as double) / cast(roster_count as double) * 100) as double) end"""


def _risk(score: str) -> str:
    return f"case when {score} >= 95 then 'LOW' when {score} >= 80 then 'MEDIUM' else 'HIGH' end"


_SEARCH_SECTION = """select * from (select '{name}' as section, cast({key} as varchar) as "key", {title} as title,
 cast({extra} as varchar) as extra from {view} where {where}
 order by 2 nulls last, 3 nulls last, 4 nulls last limit 10)"""


def _search() -> str:
    def section(name, view, key, title, extra, columns):
        where = " or ".join(f"{c} ilike '%12%'" for c in columns)
        return _SEARCH_SECTION.format(name=name, key=key, title=title, extra=extra, view=view, where=where)

    return " union all ".join([
        section("employees", "roster", "employee_id", "full_name", "department",
                ("employee_id", "full_name", "company_email", "department")),
        section("users", "users", "email", "name", "role", ("name", "email")),
        section("uploads", "upload_history", "filename", "category", "uploaded_by", ("filename",)),
        section("reports", "report_history", "filename", "manager_email", "generated_at", ("filename",)),
    ])


def _report_lines() -> str:
    titles = (
        (1, "== Roster compliance report"), (2, "== Counts"), (3, "== Departments"),
        (4, "== Recommendations"), (5, "== Matched IDs"), (6, "== IDs missing from the sheet"),
        (7, "== Sheet IDs not on the roster"), (8, "== Roster entries without e-mail"),
        (9, "== End of report"),
    )
    captions = (
        ("roster_count", "On the roster"), ("sheet_count", "On the sheet"), ("matched", "Matched"),
        ("missing", "Missing"), ("unknown", "Unknown"), ("missing_email", "Without e-mail"),
    )
    parts = [f"select manager_id, {no} as section_no, '' as line_key, '{title}' as line from summary" for no, title in titles]
    parts += [
        "select s.manager_id, 1, '1', 'Manager: ' || coalesce(m.name, s.manager_id) from summary s left join managers m on m.id = s.manager_id",
        "select manager_id, 1, '2', 'Generated: 2024-02-01 00:00:00' from summary",
        f"select manager_id, 1, '3', 'Score: ' || {_SCORE_TEXT} || '%' from summary",
        "select manager_id, 1, '4', 'Risk: ' || risk_level from summary",
    ]
    parts += [
        f"select manager_id, 2, '{i}', '{caption}: ' || {column} from summary"
        for i, (column, caption) in enumerate(captions, 1)
    ]
    parts += [
        "select manager_id, 3, lpad(cast(1000000000000000 - headcount as varchar), 16, '0') || ' ' || department, department || ': ' || headcount from departments",
        f"""select manager_id, 4, cast(row_number() over (partition by manager_id order by o) as varchar), advice from (
 select manager_id, unnest([1, 2, 3, 4]) as o, unnest([{_ADVICE}]) as advice from summary) where advice is not null""",
        "select manager_id, case status when 'MATCHED' then 5 when 'MISSING' then 6 else 7 end, employee_id, employee_id from pairs",
        "select manager_id, 8, coalesce(employee_id, '(no ID)'), coalesce(employee_id, '(no ID)') from no_email",
    ]
    return "\nunion all ".join(parts)


def statements() -> dict[str, str]:
    sql = {
        # Reconciliation.
        "compliance_summary": _with("summary", "select * from summary"),
        "reconciliation": _with("pairs", _DETAILED),
        "sketched_summary": _with("summary", "select * exclude (missing_email) from summary"),
        "reconciliation_by_bucket": _with("pairs", _DETAILED),
        "matched_ids": _with("roster_ids sheet_ids", """
select * from roster_ids r
where exists (select 1 from sheet_ids s where s.manager_id = r.manager_id and s.employee_id = r.employee_id)"""),
        "missing_ids": _with("roster_ids sheet_ids", """
select * from roster_ids r
where not exists (select 1 from sheet_ids s where s.manager_id = r.manager_id and s.employee_id = r.employee_id)"""),
        "unknown_ids": _with("roster_ids sheet_ids", """
select * from sheet_ids s
where not exists (select 1 from roster_ids r where s.manager_id = r.manager_id and s.employee_id = r.employee_id)"""),
        "ids_intersect": _with("roster_ids sheet_ids", "select * from roster_ids intersect select * from sheet_ids"),
        "ids_except": _with("roster_ids sheet_ids", """
select *, 'ROSTER_ONLY' side from (select * from roster_ids except select * from sheet_ids)
union all
select *, 'SHEET_ONLY' from (select * from sheet_ids except select * from roster_ids)"""),
        "missing_email": _with("no_email", "select * from no_email"),
        "id_quality": _with("roster sheet", """
select manager_id, side, count(*) row_count,
 count(*) filter (where employee_id is null or trim(employee_id) = '') blank_ids
from (select manager_id, 'ROSTER' side, employee_id from roster
 union all select manager_id, 'SHEET', employee_id from sheet) group by 1, 2"""),
        "department_summary": _with("departments", "select * from departments"),
        "department_compliance": _with("roster sheet_ids", f"""
select *, {_risk('compliance_score')} risk_level from (
 select *, {_SCORE} compliance_score from (
  select r.manager_id, coalesce(nullif(r.department, ''), 'Unknown') department,
   count(*) roster_count, count(s.employee_id) matched, count(*) - count(s.employee_id) missing
  from roster r left join sheet_ids s on s.manager_id = r.manager_id and s.employee_id = r.employee_id
  group by 1, 2))"""),
        "recommendations": _with("summary", """
select manager_id, coalesce(nullif(concat_ws(',',
 case when missing > 0 then 'REVIEW_MISSING' end, case when unknown > 0 then 'VERIFY_UNKNOWN' end,
 case when missing_email > 0 then 'FIX_EMAIL' end), ''), 'NO_ISSUES') codes from summary"""),
        "executive_summary": _with("summary", f"""
select manager_id, risk_level as priority, risk_level,
 'Verified ' || matched || ' out of ' || roster_count || ' roster IDs: score ' || {_SCORE_TEXT} || '%, risk ' || risk_level || '.' summary_text,
 coalesce(nullif(concat_ws(',',
  case when missing > 0 then 'REVIEW_MISSING:' || missing end,
  case when unknown > 0 then 'VERIFY_UNKNOWN:' || unknown end,
  case when missing_email > 0 then 'FIX_EMAIL:' || missing_email end,
  case when compliance_score < 90 then 'BELOW_TARGET' end), ''), 'NO_ISSUES') codes
from summary"""),
        "issues": _with("issue_rows", "select * from issue_rows"),
        "leave_mismatches": _with("mismatches", "select * from mismatches"),
        "issue_summary": _with("issue_rows", "select issue_type, count(*) issue_count from issue_rows group by 1"),
        "org_rollup": _with("summary", f"""
select *, {_risk('compliance_score')} risk_level from (
 select *, {_SCORE} compliance_score from (
  select coalesce(manager_id, 'ALL') manager_id, cast(sum(roster_count) as bigint) roster_count,
   cast(sum(sheet_count) as bigint) sheet_count, cast(sum(matched) as bigint) matched,
   cast(sum(missing) as bigint) missing, cast(sum(unknown) as bigint) as unknown,
   cast(sum(missing_email) as bigint) missing_email
  from summary group by rollup (manager_id)))"""),
        # Dashboards.
        "overview_counts": _with("roster upload_history report_history audit_logs users user_requests", """
select 'employees' metric, count(*) as value from roster
union all select 'reports', count(*) from report_history
union all select 'audit_logs', count(*) from audit_logs
union all select 'uploads_total', count(*) from upload_history
union all select 'uploads_roster_files', count(*) from upload_history where category = 'EMPLOYEE_DATA'
union all select 'uploads_sheet_files', count(*) from upload_history where category = 'GETS_SHEET'
union all select 'users_total', count(*) from users
union all select 'users_managers', count(*) from users where role = 'MANAGER'
union all select 'users_hr', count(*) from users where role = 'HR'
union all select 'requests_total', count(*) from user_requests
union all select 'requests_pending', count(*) from user_requests where status = 'PENDING'
union all select 'requests_approved', count(*) from user_requests where status = 'APPROVED'
union all select 'requests_rejected', count(*) from user_requests where status = 'REJECTED'"""),
        "department_headcount": _with("roster", """
select coalesce(nullif(department, ''), 'Unknown') department, count(*) headcount from roster group by 1"""),
        "upload_distribution": _with("upload_history", """
select count(*) total, count(*) filter (where category = 'EMPLOYEE_DATA') roster_files,
 count(*) filter (where category = 'GETS_SHEET') sheet_files from upload_history"""),
        "request_counts": _with("user_requests", """
select count(*) total, count(*) filter (where status = 'PENDING') pending,
 count(*) filter (where status = 'APPROVED') approved, count(*) filter (where status = 'REJECTED') rejected
from user_requests"""),
        "user_counts": _with("users", """
select count(*) total, count(*) filter (where role = 'MANAGER') managers, count(*) filter (where role = 'HR') hr from users"""),
        "manager_dashboard": _with("managers users headcounts upload_counts audit_logs report_history", """
select m.id manager_id, m.name, m.email,
 (select count(*) from users h where h.role = 'HR' and h.manager_id = m.id) hr_count,
 coalesce(c.headcount, 0) headcount, coalesce(u.roster_uploads, 0) roster_uploads,
 coalesce(u.sheet_uploads, 0) sheet_uploads, coalesce(u.total_uploads, 0) total_uploads,
 (select count(*) from audit_logs a where a.user_email = m.email and a.action = 'RUN_COMPARISON') comparisons,
 (select count(*) from report_history r where r.manager_email = m.email) reports_generated,
 (select count(*) from report_history r where r.downloaded_by = m.email) reports_downloaded,
 l.filename latest_report
from managers m left join headcounts c on c.id = m.id left join upload_counts u on u.email = m.email
left join (select downloaded_by, filename, row_number() over (partition by downloaded_by order by downloaded_at desc, id desc) as nth
 from report_history where downloaded_by is not null and downloaded_at is not null) l on l.downloaded_by = m.email and l.nth = 1"""),
        "hr_dashboard": _with("managers users headcounts upload_counts ranked_reports", """
select h.id hr_id, h.name hr_name, h.email hr_email, h.manager_id, m.name manager_name, m.email manager_email,
 coalesce(c.headcount, 0) headcount, coalesce(u.roster_uploads, 0) roster_uploads,
 coalesce(u.sheet_uploads, 0) sheet_uploads, coalesce(r.names, '') recent_reports
from users h left join managers m on m.id = h.manager_id left join headcounts c on c.id = m.id
left join upload_counts u on u.email = m.email
left join (select downloaded_by, string_agg(filename, ',' order by position) as names
 from ranked_reports where position <= 10 group by 1) r on r.downloaded_by = m.email
where h.role = 'HR'"""),
        "uploads_by_owner": _with("upload_history", """
select uploaded_by, category, count(*) uploads from upload_history group by 1, 2"""),
        "actions_by_user": _with("audit_logs", """
select user_email, action, count(*) actions from audit_logs group by 1, 2"""),
        "kept_upload_counts": _with("upload_history", """
select uploaded_by, count(*) row_count, count(*) filter (where category = 'EMPLOYEE_DATA') roster_files,
 count(*) filter (where category = 'GETS_SHEET') sheet_files, count(*) filter (where status = 'COMPLETED') completed,
 count(*) filter (where status = 'FAILED') failed
from upload_history group by 1"""),
        "timed_job_status": _with("job_events", """
select job, started_at, case when late then started_at + interval 2 day else ended end ended_at,
 case when late then 'FAILED' else ending end status, case when late then 'NO_END_IN_TIME' end reason
from (select *, coalesce(ended >= started_at + interval 2 day, true) late from (
 select job, status, created_at started_at, lead(created_at) over w ended, lead(status) over w ending
 from job_events window w as (partition by job order by created_at, id)))
where status = 'PROCESSING' and (late or ending <> 'PROCESSING')"""),
        "upload_outcomes": """
select u.event_id upload_id, 'user' || u.user_id as owner, u.ts uploaded_at, e.event_id end_id,
 case e.event_type when 'purchase' then 'COMPLETED' when 'error' then 'FAILED' end status, e.ts ended_at
from events u left join events e on e.user_id = u.user_id and e.event_type in ('purchase', 'error')
 and e.ts >= u.ts and e.ts < u.ts + interval 3 day
where u.event_type = 'signup'""",
        "recent_uploads": _with("upload_history", """
select filename, category, uploaded_by, created_at uploaded_at from upload_history order by created_at desc, id desc limit 5"""),
        "recent_uploads_per_manager": _with("upload_history", """
select * from (
 select uploaded_by, row_number() over (partition by uploaded_by order by created_at desc, id desc) as position,
  id, filename, category, created_at uploaded_at from upload_history) where position <= 10"""),
        "recent_reports_per_manager": _with("ranked_reports", "select * from ranked_reports where position <= 10"),
        "weekday_trend": _with("upload_history", """
select strftime(created_at, '%a') weekday, count(*) filter (where status = 'COMPLETED') verified,
 count(*) filter (where status = 'PROCESSING') pending, count(*) filter (where status = 'FAILED') flagged
from upload_history where category = 'GETS_SHEET' group by 1"""),
        "audit_trail": _with("audit_logs", "select * from audit_logs order by created_at desc, id desc"),
        "audit_daily": _with("audit_logs", """
select cast(date_trunc('day', created_at) as timestamp) as day, action, count(*) actions from audit_logs group by 1, 2"""),
        "latest_upload_per_category": _with("upload_history", """
select category, arg_max(filename, (created_at, id)) filename from upload_history group by 1"""),
        "job_status": _with("upload_history", """
select filename, status, uploaded_by, created_at uploaded_at from (
 select *, row_number() over (partition by filename order by created_at desc, id desc) as nth from upload_history)
where nth = 1"""),
        # Exploration.
        "roster_search": _with("roster", _FOUND),
        "roster_search_indexed": _with("roster", _FOUND),
        "filtered_roster_page": _with("roster", """
select * from roster where department = 'BUILDING'
 and (employee_id ilike '%9%' or full_name ilike '%9%' or company_email ilike '%9%' or department ilike '%9%')
order by full_name asc nulls last, employee_id asc nulls last, manager_id limit 20"""),
        "roster_page": _with("roster", """
select * from roster order by department desc nulls first, employee_id asc nulls last, manager_id limit 20 offset 20"""),
        "roster_page_after": _with("roster", """
select * from roster where department is not null or employee_id > '143' or (employee_id = '143' and manager_id > '3')
order by department desc nulls first, employee_id asc nulls last, manager_id limit 20"""),
        "roster_page_info": _with("roster", """
select cast(2 as bigint) as page, cast(20 as bigint) page_limit, count(*) total_records,
 cast(ceil(count(*) / 20) as bigint) total_pages from roster"""),
        "global_search": _with("roster users upload_history report_history", _search()),
        "scoped_roster_counts": _with("users headcounts", """
select u.id user_id, u.role,
 case u.role when 'MASTER_ADMIN' then (select sum(headcount) from headcounts) else coalesce(c.headcount, 0) end visible_rows
from users u left join headcounts c on c.id = case u.role when 'MANAGER' then u.id else u.manager_id end"""),
        "scoped_uploads": _with("users upload_history", """
select u.id user_id, u.role, coalesce(c.roster_files, 0) roster_files, coalesce(c.sheet_files, 0) sheet_files, c.latest_file
from users u left join users m on m.id = u.manager_id
left join (select coalesce(uploaded_by, '*') uploaded_by, count(*) filter (where category = 'EMPLOYEE_DATA') roster_files,
  count(*) filter (where category = 'GETS_SHEET') sheet_files, arg_max(filename, (created_at, id)) latest_file
 from upload_history group by rollup(uploaded_by)) c
 on c.uploaded_by = case u.role when 'MANAGER' then u.email when 'MASTER_ADMIN' then '*' else m.email end"""),
        "report_history_for_manager": _with("report_history", """
select cast(id as varchar) id, manager_email, filename, generated_at, downloaded_by, downloaded_at
from report_history where manager_email = 'user3@example.com'"""),
        "pending_requests": _with("user_requests", """
select cast(id as varchar) id, email, requested_role from user_requests where status = 'PENDING'"""),
        "effective_permissions": _with("users user_roles", """
select u.id user_id, u.role, p.permission,
 case when u.role = 'HR' and p.permission in ('can_upload_employee', 'can_upload_gets', 'can_compare',
   'can_download_reports', 'can_manage_users', 'can_create_roles', 'can_assign_manager', 'can_approve_requests') then false
 else coalesce(case p.permission when 'can_upload' then r.can_upload
   when 'can_download' then r.can_download
   when 'can_view_reports' then r.can_view_reports
   when 'can_generate_reports' then r.can_generate_reports
   when 'can_receive_email' then r.can_receive_email
   when 'can_manage_users' then r.can_manage_users
   when 'can_upload_employee' then r.can_upload_employee
   when 'can_upload_gets' then r.can_upload_gets
   when 'can_compare' then r.can_compare
   when 'can_download_reports' then r.can_download_reports
   when 'can_create_roles' then r.can_create_roles
   when 'can_assign_manager' then r.can_assign_manager
   when 'can_approve_requests' then r.can_approve_requests end, false) end allowed
from users u left join user_roles r on r.role_name = u.role
cross join (values ('can_upload'), ('can_download'), ('can_view_reports'), ('can_generate_reports'), ('can_receive_email'), ('can_manage_users'), ('can_upload_employee'), ('can_upload_gets'), ('can_compare'), ('can_download_reports'), ('can_create_roles'), ('can_assign_manager'), ('can_approve_requests')) as p(permission)"""),
        # Ingest and maintenance.
        "file_type": _with("file_extensions", """
select doc_id, extension,
 case extension when '.csv' then 'CSV' when '.xlsx' then 'EXCEL' when '.xls' then 'EXCEL' when '.pdf' then 'PDF'
  when '.png' then 'IMAGE' when '.jpg' then 'IMAGE' when '.jpeg' then 'IMAGE' else 'UNKNOWN' end file_type,
 case extension when '.csv' then 'CSV' when '.xlsx' then 'EXCEL' when '.xls' then 'EXCEL' else 'UNSUPPORTED' end reader
from file_extensions"""),
        "file_hash": _with("files", "select doc_id, sha256(content) file_hash from files"),
        "sanitized_names": _with("files", """
select doc_id, filename, regexp_replace(regexp_extract(filename, '([^/]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') stored_name
from files"""),
        "upload_admission": _with("files file_extensions", """
select f.doc_id, f.filename,
 case when e.extension not in ('.csv', '.xlsx', '.xls') then 'BAD_EXTENSION'
  when f.content_type not in ('text/csv', 'application/vnd.ms-excel',
   'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet') then 'BAD_CONTENT_TYPE'
  when f.size_bytes > 52428800 then 'TOO_LARGE' else 'ACCEPTED' end verdict
from files f join file_extensions e on e.doc_id = f.doc_id"""),
        "duplicate_files": _with("files upload_history", """
select doc_id, filename, case when nth > 1 then 'REPEATED_IN_BATCH'
 when file_hash in (select file_hash from upload_history) then 'IN_HISTORY' else 'NEW' end verdict
from (select doc_id, filename, sha256(content) file_hash,
 row_number() over (partition by sha256(content) order by doc_id) as nth from files)"""),
        "duplicate_uploads": _with("files upload_history", """
select id, filename, case when nth > 1 then 'REPEATED_IN_BATCH'
 when file_hash in (select sha256(content) from files) then 'IN_HISTORY' else 'NEW' end verdict
from (select *, row_number() over (partition by file_hash order by id) as nth from upload_history)"""),
        "dataset_profile": _with("files roster incoming_roster", """
select 'files' dataset, 'doc_id,filename,content_type,size_bytes,content' as columns, cast(5 as bigint) column_count, count(*) row_count from files
union all select 'roster', 'employee_id,full_name,company_email,department,manager_id', 5, count(*) from roster
union all select 'incoming', 'row_no,employee_id,full_name,manager_id', 4, count(*) from incoming_roster"""),
        "dataset_preview": _with("files", "select * from files order by doc_id limit 10"),
        "batch_preview": _with("incoming_roster", """
select * from (select *, row_number() over (partition by manager_id order by row_no) as position from incoming_roster)
where position <= 10"""),
        "header_mapping": _with("file_headers", """
select h.*, case lower(trim(header, ' ' || chr(9)))
 when 'employee id' then 'employee_id' when 'emp id' then 'employee_id' when 'associate id' then 'employee_id'
 when 'employee name' then 'employee_name' when 'name' then 'employee_name' when 'department' then 'department'
 when 'company email' then 'company_email' when 'email' then 'company_email' end canonical
from file_headers h"""),
        "import_new_rows": _with("first_new_rows", "select employee_id, row_no, full_name, manager_id from first_new_rows"),
        "import_counts": _with("first_new_rows", """
select i.manager_id, count(n.row_no) inserted, count(*) - count(n.row_no) skipped, cast(0 as bigint) blank_ids
from incoming_roster i left join first_new_rows n on n.row_no = i.row_no group by 1"""),
        "apply_changes_latest": _with("report_history report_downloads", _STAMPED),
        "rewritten_reports": _with("report_history report_downloads", _STAMPED),
        "assignment_validation": _with("assignment_outcomes", "select * from assignment_outcomes"),
        "assigned_users": _with("assignment_outcomes users", """
select u.id, u.name, u.email, u.role, coalesce(a.manager_id, u.manager_id) manager_id
from users u left join (
 select *, row_number() over (partition by hr_id order by seq desc) as nth from assignment_outcomes where outcome = 'OK') a
on a.hr_id = u.id and a.nth = 1"""),
        "request_decisions": _with("outcomes", "select * from outcomes"),
        "decided_requests": _with("outcomes user_requests", """
select r.id, r.email, r.requested_role, coalesce(o.outcome, r.status) status, r.created_at
from user_requests r left join (select * from outcomes where outcome in ('APPROVED', 'REJECTED')) o on o.request_id = r.id"""),
        # Reports.
        "report_lines": _with("summary managers departments pairs no_email", f"""
select *, row_number() over (partition by manager_id order by section_no, line_key, line) line_no from ({_report_lines()})"""),
        "notifications": _with("summary managers", f"""
select m.email receiver, 'Your compliance report: risk ' || risk_level subject,
 concat_ws(chr(10), 'Dear ' || m.name || ',', 'your sheet has been compared with the roster.',
  'Score: ' || {_SCORE_TEXT} || '%', 'Risk: ' || risk_level,
  'On the roster: ' || roster_count, 'On the sheet: ' || sheet_count, 'Matched: ' || matched,
  'Missing: ' || missing, 'Unknown: ' || unknown, 'Without e-mail: ' || missing_email,
  concat_ws(chr(10), {_ADVICE}), 'Report: report_' || manager_id || '_20240201_000000.txt') body
from summary s join managers m on m.id = s.manager_id"""),
        "result_documents": _with("summary", """
select s.manager_id, s.compliance_score, s.risk_level,
 coalesce(nullif(concat_ws(',', case when missing > 0 then 'REVIEW_MISSING' end, case when unknown > 0 then 'VERIFY_UNKNOWN' end,
  case when missing_email > 0 then 'FIX_EMAIL' end), ''), 'NO_ISSUES') recommendations
from summary s"""),
        "result_entries": _with("departments pairs no_email", """
select manager_id, status as list, employee_id as value, 1 n from pairs
union all select manager_id, 'NO_EMAIL', employee_id, count(*) from no_email group by 1, 3
union all select manager_id, 'DEPARTMENT', department, headcount from departments"""),
    }
    return sql
