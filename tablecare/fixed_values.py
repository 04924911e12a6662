"""Fixed values.

Everything in this module is a value that must be exactly what it is for
results to be right: word lists, patterns, formats and thresholds. They are
kept together, as plain text, so that they can be read and checked at a glance.
"""

# --- whitespace -------------------------------------------------------------
# Every character that counts as whitespace when text is stripped or split:
# the ASCII controls (including the four separators 0x1c-0x1f), the space, and
# the Unicode spaces and line separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- semantic types ---------------------------------------------------------
UNKNOWN = "unknown"

HEADER_ALIASES = {
    "email": ("email", "e-mail", "email_address", "emailaddress", "mail"),
    "phone_number": ("phone", "mobile", "tel", "telephone", "phone_number", "contact_number"),
    "first_name": ("first_name", "firstname", "first", "fname", "given_name"),
    "last_name": ("last_name", "lastname", "last", "lname", "surname", "family_name"),
    "full_name": ("name", "full_name", "fullname", "contact_name", "person"),
    "company_name": (
        "company", "company_name", "organization", "organisation", "org", "employer", "firm",
    ),
    "url": ("url", "website", "web", "link", "homepage", "site"),
    "linkedin_profile": ("linkedin", "linkedin_url", "linkedin_profile"),
}

COMPANY_SUFFIXES = (
    "llc", "inc", "ltd", "corp", "gmbh", "pvt", "llp", "co.", "plc", "s.a.", "ag", "pte",
    "limited", "incorporated", "corporation", "pvt ltd", "pvt. ltd.", "private limited",
)

EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
NAME_TOKEN = r"[A-Za-z]+(?:[-'][A-Za-z]+)*"

FULL_NAME_LENGTH = (3, 60)
FULL_NAME_TOKENS = (2, 4)
SINGLE_NAME_LENGTH = (2, 20)
PHONE_DIGITS = (7, 15)

CONFIDENCE_THRESHOLD = 0.60
HEADER_BOOST = 0.20
MIN_VALUES = 3

# --- row validation ---------------------------------------------------------
BLANK_EMAIL = "BLANK_EMAIL"
INVALID_DOMAIN = "INVALID_DOMAIN"
INVALID_EMAIL_FORMAT = "INVALID_EMAIL_FORMAT"

ROLE_PREFIXES = (
    "info", "sales", "support", "admin", "contact", "hello", "team", "billing", "help",
    "noreply", "no-reply", "postmaster", "webmaster", "abuse",
)

# --- profiling and quality thresholds ---------------------------------------
IDENTIFIER_RATIO = 0.9
CATEGORICAL_MAX_UNIQUE = 20

NULL_WARNING_PCT = 5.0
NULL_CRITICAL_PCT = 30.0
HIGH_CARDINALITY_MIN_UNIQUE = 50
HIGH_CARDINALITY_MAX_RATIO = 0.9
IQR_FACTOR = 1.5
OUTLIER_MIN_VALUES = 4

SUGGEST_MISSING_HIGH_PCT = 40.0
SUGGEST_MISSING_MEDIUM_PCT = 10.0
SUGGEST_DUPLICATES_HIGH_PCT = 10.0
SUGGEST_NUMERIC_RATE = 0.8

# Score: weight per percentage point (or per column) and the cap of each penalty.
MISSING_PENALTY = (0.4, 40.0)
DUPLICATE_PENALTY = (0.2, 20.0)
CONSTANT_PENALTY = (5.0, 20.0)
OUTLIER_PENALTY = (3.0, 15.0)

SCORE_LABELS = ((85, "Excellent"), (70, "Good"), (50, "Moderate"))
SCORE_LABEL_LOWEST = "Poor"
REPORT_GRADES = (
    (95, "A+ (Excellent)"), (90, "A (Very Good)"), (80, "B (Good)"), (70, "C (Fair)"),
    (60, "D (Poor)"),
)
REPORT_GRADE_LOWEST = "F (Critical)"
REPORT_GRADE_CRITICAL = "CRITICAL"
REPORT_STATUSES = ((90, "HEALTHY"), (80, "REVIEW"))
REPORT_STATUS_LOWEST = "NEEDS ATTENTION"
REPORT_STATUS_CRITICAL = "ACTION REQUIRED"

# Fixed codes of issues, advice and scopes.
MISSING = "missing_values"
DUPLICATES = "duplicates"
CONSTANT = "constant_column"
HIGH_CARDINALITY = "high_cardinality"
OUTLIERS = "outliers"
TYPE_CONVERSION = "type_conversion"
ALL_COLUMNS = "all columns"
WHOLE_TABLE = "dataset"

# --- cleaning and coercion --------------------------------------------------
NULL_DROP_RATIO = 0.60
SINGLE_VALUE_MIN_ROWS = 10
IMPUTE_MAX_NULL_RATIO = 0.60
CATEGORICAL_FILL = "Unknown"
FLAG_SUFFIX = "__was_null"

# Fixed codes of what cleaning did, and of why it did not.
FILLED = "filled_"
FLAGGED = "flagged"
SKIPPED = "skipped"
ROWS_DROPPED = "drop_rows"
LEFT_ALONE = "no_action"
TOO_SPARSE = "null_ratio_too_high"
LISTED = "force_drop"
SINGLE_VALUE = "single_unique_value"

TRUE_WORDS = ("true", "yes", "1", "y")
FALSE_WORDS = ("false", "no", "0", "n")
NUMBER_RATE = 0.95
TIMESTAMP_RATE = 0.90

# A decimal number as text, after stripping; the words stand for infinity.
NUMBER_PATTERN = r"^[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"

# Timestamp formats in order of preference, each with the shape a value must
# have before it is worth parsing.
TIMESTAMP_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd HH:mm", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.(?:\d{3}|\d{6})$"),
    ("yyyy-MM-dd'T'HH:mm", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.(?:\d{3}|\d{6}))?$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
     r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.(?:\d{3}|\d{6}))?(?:Z|[+-]\d{2}:\d{2})$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("yyyy/MM/dd HH:mm:ss", r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("d/M/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("M/d/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("d/M/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("M.d.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]{3,9} \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
)

# --- CSV --------------------------------------------------------------------
DELIMITERS = (",", ";", "\t", "|")
DEFAULT_DELIMITER = ","

# Cell texts that a CSV reader must treat as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CSV_TRUE_WORDS = ("True", "TRUE", "true")
CSV_FALSE_WORDS = ("False", "FALSE", "false")
