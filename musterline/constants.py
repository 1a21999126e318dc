"""Fixed values shared by the whole package.

Everything in this module is data that results depend on (codes, thresholds,
allow-lists, header names); none of it is logic.
"""

# --- fixed values: match status, risk levels, issue types -------------------
MATCHED = "MATCHED"
MISSING = "MISSING"
UNKNOWN = "UNKNOWN"

RISK_LOW = "LOW"
RISK_MEDIUM = "MEDIUM"
RISK_HIGH = "HIGH"
LOW_RISK_FROM = 95
MEDIUM_RISK_FROM = 80
TARGET_SCORE = 90

ISSUE_TYPES = ("MISSING_IN_GETS", "UNKNOWN_EMPLOYEE", "LEAVE_MISMATCH")

# --- fixed values: recommendation codes -------------------------------------
REVIEW_MISSING = "REVIEW_MISSING"
VERIFY_UNKNOWN = "VERIFY_UNKNOWN"
FIX_EMAIL = "FIX_EMAIL"
BELOW_TARGET = "BELOW_TARGET"
NO_ISSUES = "NO_ISSUES"

# Our wording for each code, used in reports and messages.
ADVICE = {
    REVIEW_MISSING: "Check the roster IDs that the sheet leaves out.",
    VERIFY_UNKNOWN: "Trace the sheet IDs that no roster entry explains.",
    FIX_EMAIL: "Fill in the company e-mail addresses that are blank.",
    BELOW_TARGET: "The score is under the 90 percent target; look into it soon.",
    NO_ISSUES: "Nothing to follow up.",
}

# --- fixed values: entity enumerations --------------------------------------
ROSTER_FILE = "EMPLOYEE_DATA"
SHEET_FILE = "GETS_SHEET"

STATUS_UPLOADED = "UPLOADED"
STATUS_PROCESSING = "PROCESSING"
STATUS_COMPLETED = "COMPLETED"
STATUS_FAILED = "FAILED"

REQUEST_PENDING = "PENDING"
REQUEST_APPROVED = "APPROVED"
REQUEST_REJECTED = "REJECTED"

ROLE_ADMIN = "MASTER_ADMIN"
ROLE_MANAGER = "MANAGER"
ROLE_HR = "HR"

ACTION_COMPARE = "RUN_COMPARISON"
ACTION_SHEET_DONE = "BACKGROUND_GETS_PROCESS"

UNKNOWN_DEPARTMENT = "Unknown"

# --- fixed values: permission flags -----------------------------------------
PERMISSION_FLAGS = (
    "can_upload",
    "can_download",
    "can_view_reports",
    "can_generate_reports",
    "can_receive_email",
    "can_manage_users",
    "can_upload_employee",
    "can_upload_gets",
    "can_compare",
    "can_download_reports",
    "can_create_roles",
    "can_assign_manager",
    "can_approve_requests",
)
HR_DENIED = (
    "can_upload_employee",
    "can_upload_gets",
    "can_compare",
    "can_download_reports",
    "can_manage_users",
    "can_create_roles",
    "can_assign_manager",
    "can_approve_requests",
)

# --- fixed values: file admission -------------------------------------------
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
ALLOWED_EXTENSIONS = (".csv", ".xlsx", ".xls")
ALLOWED_CONTENT_TYPES = (
    "text/csv",
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
)
FILE_TYPES = {
    ".csv": "CSV",
    ".xlsx": "EXCEL",
    ".xls": "EXCEL",
    ".pdf": "PDF",
    ".png": "IMAGE",
    ".jpg": "IMAGE",
    ".jpeg": "IMAGE",
}
FILE_TYPE_OTHER = "UNKNOWN"

# --- fixed values: header synonyms ------------------------------------------
# Site-specific headers are passed to the header functions as ``extra``.
HEADER_SYNONYMS = {
    "employee id": "employee_id",
    "emp id": "employee_id",
    "associate id": "employee_id",
    "employee name": "employee_name",
    "name": "employee_name",
    "department": "department",
    "company email": "company_email",
    "email": "company_email",
    "customer leave": "customer_leave",
    "internal leave": "internal_leave",
}
SHEET_COLUMNS = (
    "employee_id",
    "employee_name",
    "department",
    "company_email",
    "customer_leave",
    "internal_leave",
)
LEAVE_COLUMNS = ("customer_leave", "internal_leave")

# --- fixed values: list sizes -----------------------------------------------
SEARCH_HITS = 10
PREVIEW_ROWS = 10
PAGE_SIZE = 20
RECENT_UPLOADS_OVERALL = 5
RECENT_PER_OWNER = 10
SORTABLE_COLUMNS = ("employee_id", "full_name", "department", "created_at")
