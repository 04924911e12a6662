"""Queries on contact tables: recognition, formatting, validation, deduplication, the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import registry as sql
from catalog.registry import query
from catalog.views import table, view
from tablecare import fixed_values as fv
from tablecare.functions import detectors, emails, text
from tablecare.operators import dedupe, normalize, semantic, validate
from tablecare.plans.leads import process_leads
from tablecare.plans.survivors import Survivors
from tablecare.sources.staging import new_path

# What the columns of the two contact views mean, for queries about a single step.
LEADS_PROFILE = semantic.SemanticProfile.of(
    {"name": "full_name", "email": "email", "phone": "phone_number"}
)
SIGNUPS_PROFILE = semantic.SemanticProfile.of({
    "full_name": "full_name", "email": "email", "mail": "email", "mobile": "phone_number",
    "org": "company_name", "site": "url", "nickname": "first_name",
})
SIGNUP_TEXTS = ("full_name", "email", "mail", "mobile", "org", "site", "nickname", "priority")


# --- recognition -----------------------------------------------------------------


def _counts_sql(source: str, columns) -> str:
    parts = []
    for c in columns:
        hits = ", ".join(
            f"count(*) FILTER ({test(c)}) AS n_{name}" for name, test in sql.DETECTOR_SQL.items()
        )
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) AS n_rows, "
            f"count(*) FILTER ({sql.strip(c)} <> {c}) AS n_untrimmed, "
            f"count(*) FILTER ({sql.strip(c)} <> '') AS n_values, {hits} FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _counts(df: DataFrame, names) -> DataFrame:
    return semantic.match_counts(df, list(names)).drop("column_no")


def _flags_sql(source: str, key: str, column: str) -> str:
    tests = ", ".join(
        f"coalesce({test(column)}, false) AS {name}" for name, test in sql.DETECTOR_SQL.items()
    )
    return f"SELECT {key}, {tests} FROM {source}"


def _flags(df: DataFrame, key: str, column: str) -> DataFrame:
    tests = [
        F.coalesce(test(F.col(column)), F.lit(False)).alias(name)
        for name, test in detectors.DETECTORS.items()
    ]
    return df.select(key, *tests)


@query("detect_lead_names", _flags_sql("leads", "row_id", "name"), ("leads",))
def detect_lead_names(spark, sf_dir):
    return _flags(view(spark, sf_dir, "leads"), "row_id", "name")


@query("detect_signup_orgs", _flags_sql("signups", "row_id", "org"), ("signups",))
def detect_signup_orgs(spark, sf_dir):
    return _flags(view(spark, sf_dir, "signups"), "row_id", "org")


@query("detect_signup_sites", _flags_sql("signups", "row_id", "site"), ("signups",))
def detect_signup_sites(spark, sf_dir):
    return _flags(view(spark, sf_dir, "signups"), "row_id", "site")


@query("detect_signup_phones", _flags_sql("signups", "row_id", "mobile"), ("signups",))
def detect_signup_phones(spark, sf_dir):
    return _flags(view(spark, sf_dir, "signups"), "row_id", "mobile")


@query("detect_document_texts", _flags_sql("documents", "doc_id", "text"))
def detect_document_texts(spark, sf_dir):
    return _flags(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("semantic_match_counts_leads", _counts_sql("leads", ("name", "email", "phone")), ("leads",))
def semantic_match_counts_leads(spark, sf_dir):
    return _counts(view(spark, sf_dir, "leads"), ("name", "email", "phone"))


@query("semantic_match_counts_signups", _counts_sql("signups", SIGNUP_TEXTS), ("signups",))
def semantic_match_counts_signups(spark, sf_dir):
    return _counts(view(spark, sf_dir, "signups"), SIGNUP_TEXTS)


@query("semantic_match_counts_customer", _counts_sql("customer", ("c_name", "c_mktsegment")))
def semantic_match_counts_customer(spark, sf_dir):
    return _counts(table(spark, sf_dir, "customer"), ("c_name", "c_mktsegment"))


@query("semantic_match_counts_pages", _counts_sql("pages", ("url",)))
def semantic_match_counts_pages(spark, sf_dir):
    return _counts(table(spark, sf_dir, "pages"), ("url",))


def _profile_sql(source: str, texts, others: dict) -> str:
    """Score every (column, detector), keep the best, and name it if it is sure enough."""

    def hinted(column, kind):
        header = column.strip().lower().replace(" ", "_")
        return header in fv.HEADER_ALIASES.get(kind, ())

    scored = []
    for c in texts:
        for order, name in enumerate(sql.DETECTOR_SQL):
            kind = name
            if name == "single_name":
                kind = "last_name" if hinted(c, "last_name") else "first_name"
            boost = hinted(c, kind)
            scored.append(
                f"SELECT '{c}' AS col, '{kind}' AS kind, {order} AS place, n_{name} AS hits, n_values, "
                f"{str(boost).lower()} AS hinted, "
                f"round(least(1.0, n_{name}::DOUBLE / n_values + {0.2 if boost else 0.0}), 2) AS conf "
                f"FROM counts WHERE \"column\" = '{c}' AND n_values >= 3"
            )
    few = f"""UNION ALL SELECT "column", 'unknown', 0.0::DOUBLE, 'only ' || n_values::VARCHAR
  || ' non-null values; below minimum threshold of 3', false, n_values, 0::BIGINT, 'none' FROM counts WHERE n_values < 3"""
    fixed = " ".join(
        f"UNION ALL SELECT '{c}', 'unknown', 0.0::DOUBLE, "
        f"'column dtype is {dtype}; skipped semantic detection', false, 0::BIGINT, 0::BIGINT, 'none'"
        for c, dtype in others.items()
    )
    return f"""WITH counts AS ({_counts_sql(source, texts)}),
scored AS ({' UNION ALL '.join(scored)}),
best AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY conf DESC, place) AS rn,
  bool_or(hinted) OVER (PARTITION BY col) AS any_hint FROM scored)
SELECT col AS "column", CASE WHEN conf >= 0.6 THEN kind ELSE 'unknown' END AS semantic_type,
  conf AS confidence,
  CASE WHEN conf >= 0.6 THEN hits::VARCHAR || '/' || n_values::VARCHAR || ' sampled values matched '
    || kind || ' pattern' || CASE WHEN hinted THEN '; header boost applied' ELSE '' END
    ELSE 'no detector exceeded confidence threshold of 0.60' END AS reason,
  CASE WHEN conf >= 0.6 THEN hinted ELSE any_hint END AS header_matched,
  n_values AS sample_size, hits AS match_count,
  CASE WHEN conf >= 0.6 THEN 'regex_v1' ELSE 'none' END AS detector
FROM best WHERE rn = 1 {few} {fixed}"""


@query("semantic_profile_leads", _profile_sql("leads", ("name", "email", "phone"), {}), ("leads",))
def semantic_profile_leads(spark, sf_dir):
    return semantic.semantic_profile(view(spark, sf_dir, "leads"), row_id="row_id").to_df(spark)


@query(
    "semantic_profile_signups",
    _profile_sql("signups", SIGNUP_TEXTS, {"spent": "double"}),
    ("signups",),
)
def semantic_profile_signups(spark, sf_dir):
    return semantic.semantic_profile(view(spark, sf_dir, "signups"), row_id="row_id").to_df(spark)


@query(
    "semantic_profile_few_values",
    _profile_sql("few_addresses", ("name", "two", "three"), {}),
    ("few_addresses",),
)
def semantic_profile_few_values(spark, sf_dir):
    """Two addresses in a column are too few to tell what it holds, three are not."""
    return semantic.semantic_profile(view(spark, sf_dir, "few_addresses"), row_id="row_id").to_df(spark)


@query(
    "semantic_type_summary",
    f"""WITH found AS ({_profile_sql("signups", SIGNUP_TEXTS, {"spent": "double"})})
SELECT semantic_type, array_to_string(list_sort(list("column")), ',') AS columns,
  count(*) AS n_columns FROM found GROUP BY semantic_type""",
    ("signups",),
)
def semantic_type_summary(spark, sf_dir):
    profile = semantic.semantic_profile(view(spark, sf_dir, "signups"), row_id="row_id")
    return profile.summary_df(spark).withColumn("columns", F.array_join("columns", ","))



# --- formatting ------------------------------------------------------------------


@query(
    "lead_trim",
    f"SELECT row_id, {', '.join(f'{sql.strip(c)} AS {c}' for c in SIGNUP_TEXTS)} FROM signups",
    ("signups",),
)
def lead_trim(spark, sf_dir):
    df = view(spark, sf_dir, "signups")
    return df.select("row_id", *[text.strip(F.col(c)).alias(c) for c in SIGNUP_TEXTS])


@query("lead_title_case", f"SELECT row_id, {sql.title('name')} AS name FROM leads", ("leads",))
def lead_title_case(spark, sf_dir):
    return view(spark, sf_dir, "leads").select("row_id", text.title_case(F.col("name")).alias("name"))


@query(
    "signup_title_case",
    f"SELECT row_id, {sql.title('full_name')} AS full_name, {sql.title('nickname')} AS nickname "
    "FROM signups",
    ("signups",),
)
def signup_title_case(spark, sf_dir):
    df = view(spark, sf_dir, "signups")
    return df.select(
        "row_id",
        text.title_case(F.col("full_name")).alias("full_name"),
        text.title_case(F.col("nickname")).alias("nickname"),
    )


@query(
    "lead_normalize_email",
    f"SELECT row_id, lower({sql.strip('email')}) AS email FROM leads",
    ("leads",),
)
def lead_normalize_email(spark, sf_dir):
    df = view(spark, sf_dir, "leads")
    steps = {"title_case_names": False, "split_full_names": False}
    return normalize.format_leads(df, LEADS_PROFILE, steps, "row_id").select("row_id", "email")


@query(
    "lead_split_name",
    f"SELECT row_id, {sql.first_word('name')} AS first_name, {sql.other_words('name')} AS last_name "
    "FROM leads",
    ("leads",),
)
def lead_split_name(spark, sf_dir):
    df = view(spark, sf_dir, "leads")
    steps = {"title_case_names": False, "trim_whitespace": False, "normalize_emails": False}
    return normalize.format_leads(df, LEADS_PROFILE, steps, "row_id").select(
        "row_id", "first_name", "last_name"
    )


_FORMATTED_SIGNUPS = f"""SELECT row_id, {sql.title('full_name')} AS full_name,
  {sql.first_word(sql.title('full_name'))} AS first_name,
  {sql.other_words(sql.title('full_name'))} AS last_name,
  lower({sql.strip('email')}) AS email, lower({sql.strip('mail')}) AS mail,
  {', '.join(f'{sql.strip(c)} AS {c}' for c in ("mobile", "org", "site", "priority"))},
  {sql.title('nickname')} AS nickname, spent
FROM signups"""


@query("lead_format", _FORMATTED_SIGNUPS, ("signups",))
def lead_format(spark, sf_dir):
    return normalize.format_leads(view(spark, sf_dir, "signups"), SIGNUPS_PROFILE, row_id="row_id")


_CHANGES_SQL = f"""SELECT
  CAST({' + '.join(f'count(*) FILTER ({sql.strip(c)} <> {c})' for c in SIGNUP_TEXTS)} AS BIGINT)
    AS whitespace_fixes,
  CAST(count(*) FILTER ({sql.title('full_name')} <> {sql.strip('full_name')})
    + count(*) FILTER ({sql.title('nickname')} <> {sql.strip('nickname')}) AS BIGINT)
    AS name_fields_formatted,
  CAST(count(*) FILTER (lower({sql.strip('email')}) <> {sql.strip('email')})
    + count(*) FILTER (lower({sql.strip('mail')}) <> {sql.strip('mail')}) AS BIGINT)
    AS email_fields_normalized,
  count(*) FILTER (NOT {sql.blank('full_name')}) AS full_names_split
FROM signups"""


@query("lead_format_changes", _CHANGES_SQL, ("signups",))
def lead_format_changes(spark, sf_dir):
    return normalize.format_changes(view(spark, sf_dir, "signups"), SIGNUPS_PROFILE, row_id="row_id")


# --- validation ------------------------------------------------------------------


@query(
    "lead_blank_flags",
    f"""SELECT row_id, {sql.blank('name')} AS name_blank, {sql.blank('email')} AS email_blank,
  {sql.blank('phone')} AS phone_blank FROM leads""",
    ("leads",),
)
def lead_blank_flags(spark, sf_dir):
    df = view(spark, sf_dir, "leads")
    return df.select(
        "row_id", *[text.is_blank(F.col(c)).alias(f"{c}_blank") for c in ("name", "email", "phone")]
    )


@query(
    "lead_reject_reasons",
    f"""SELECT {sql.reason('email')} AS rejection_reason, count(*) AS n FROM leads GROUP BY 1""",
    ("leads",),
)
def lead_reject_reasons(spark, sf_dir):
    checked = validate.check_leads(view(spark, sf_dir, "leads"), ["email"])
    return checked.groupBy("rejection_reason").agg(F.count("*").alias("n"))


@query(
    "lead_valid",
    f"""SELECT row_id, name, email, phone, {sql.is_role('email')} AS is_role_email
FROM leads WHERE {sql.reason('email')} IS NULL""",
    ("leads",),
)
def lead_valid(spark, sf_dir):
    return validate.validate_leads(view(spark, sf_dir, "leads"), LEADS_PROFILE).valid


@query(
    "lead_rejected",
    f"""SELECT row_id, name, email, phone, {sql.reason('email')} AS rejection_reason
FROM leads WHERE {sql.reason('email')} IS NOT NULL""",
    ("leads",),
)
def lead_rejected(spark, sf_dir):
    return validate.validate_leads(view(spark, sf_dir, "leads"), LEADS_PROFILE).rejected


@query(
    "lead_role_flags",
    f"SELECT row_id, {sql.is_role('email')} AS is_role_email FROM leads",
    ("leads",),
)
def lead_role_flags(spark, sf_dir):
    df = view(spark, sf_dir, "leads")
    flag = F.coalesce(emails.is_role_email(text.strip(F.col("email"))), F.lit(False))
    return df.select("row_id", flag.alias("is_role_email"))


def _report_sql(source: str, columns) -> str:
    """Counts of the validation report over any number of address columns."""
    why = f"coalesce({', '.join(sql.reason(c) for c in columns)})"
    roles = " + ".join(
        f"count(*) FILTER ({sql.is_email(c)} AND {sql.is_role(c)})" for c in columns
    )
    return f"""SELECT count(*) AS total_rows, count(*) FILTER ({why} IS NULL) AS valid_rows,
  count({why}) AS rejected_rows, count(*) FILTER ({why} LIKE 'INVALID%') AS invalid_email_count,
  count(*) FILTER ({why} = 'BLANK_EMAIL') AS blank_email_count,
  CAST({roles} AS BIGINT) AS role_based_email_count FROM {source}"""


@query("lead_validation_report", _report_sql("leads", ["email"]), ("leads",))
def lead_validation_report(spark, sf_dir):
    return validate.validate_leads(view(spark, sf_dir, "leads"), LEADS_PROFILE).report


@query("signup_validation_report", _report_sql("signups", ["email", "mail"]), ("signups",))
def signup_validation_report(spark, sf_dir):
    return validate.validate_leads(view(spark, sf_dir, "signups"), SIGNUPS_PROFILE).report


@query(
    "lead_two_email_columns",
    f"""SELECT row_id, coalesce({sql.reason('email')}, {sql.reason('mail')}) AS rejection_reason,
  ({sql.is_email('email')} AND {sql.is_role('email')}) IS TRUE
    OR ({sql.is_email('mail')} AND {sql.is_role('mail')}) IS TRUE AS is_role_email
FROM signups""",
    ("signups",),
)
def lead_two_email_columns(spark, sf_dir):
    checked = validate.check_leads(view(spark, sf_dir, "signups"), ["email", "mail"])
    return checked.select("row_id", "rejection_reason", "is_role_email")


@query(
    "lead_validate_loose",
    f"""SELECT row_id, email, {sql.is_role('email')} AS is_role_email FROM leads
WHERE NOT {sql.blank('email')}""",
    ("leads",),
)
def lead_validate_loose(spark, sf_dir):
    """Formats unchecked: only blank addresses are rejected."""
    loose = {"strict_email_validation": False}
    split = validate.validate_leads(view(spark, sf_dir, "leads"), LEADS_PROFILE, loose)
    return split.valid.select("row_id", "email", "is_role_email")


@query(
    "lead_validate_blanks_pass",
    f"""SELECT row_id, email FROM leads
WHERE {sql.blank('email')} OR {sql.reason('email')} IS NULL""",
    ("leads",),
)
def lead_validate_blanks_pass(spark, sf_dir):
    """Blank addresses pass and rows carry no role flag."""
    cfg = {"reject_blank_emails": False, "flag_role_accounts": False}
    return validate.validate_leads(view(spark, sf_dir, "leads"), LEADS_PROFILE, cfg).valid.select(
        "row_id", "email"
    )


# --- deduplication ---------------------------------------------------------------


@query(
    "lead_dedupe_exact",
    "SELECT name, email, phone, min(row_id) AS row_id FROM leads GROUP BY name, email, phone",
    ("leads",),
)
def lead_dedupe_exact(spark, sf_dir):
    return dedupe.drop_exact_duplicates(view(spark, sf_dir, "leads"), "row_id")


@query(
    "lead_dedupe_exact_by_digest",
    "SELECT name, email, phone, min(row_id) AS row_id FROM leads GROUP BY name, email, phone",
    ("leads",),
)
def lead_dedupe_exact_by_digest(spark, sf_dir):
    return dedupe.drop_exact_duplicates_by_digest(view(spark, sf_dir, "leads"), "row_id")


@query(
    "lead_completeness",
    f"SELECT row_id, {sql.score('name', 'email', 'phone')} AS score FROM leads",
    ("leads",),
)
def lead_completeness(spark, sf_dir):
    df = view(spark, sf_dir, "leads")
    return df.select("row_id", dedupe.completeness(df, "row_id").alias("score"))


@query(
    "lead_email_key",
    f"SELECT row_id, nullif(lower({sql.strip('email')}), '') AS email_key FROM leads",
    ("leads",),
)
def lead_email_key(spark, sf_dir):
    df = view(spark, sf_dir, "leads")
    return df.select("row_id", emails.email_key(F.col("email")).alias("email_key"))


def _best_sql(source: str, email: str, score: str) -> str:
    key = f"coalesce(nullif(lower({sql.strip(email)}), ''), '__blank_' || row_id::VARCHAR)"
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY {key} ORDER BY {score} DESC, row_id) AS rn FROM {source}) WHERE rn = 1"""


@query(
    "lead_dedupe_email",
    _best_sql(
        f"(SELECT * FROM leads WHERE {sql.reason('email')} IS NULL)", "email",
        sql.score("name", "email", "phone"),
    ),
    ("leads",),
)
def lead_dedupe_email(spark, sf_dir):
    """Valid leads, one per address, the fullest first."""
    cfg = {"flag_role_accounts": False}
    valid = validate.validate_leads(view(spark, sf_dir, "leads"), LEADS_PROFILE, cfg).valid
    return dedupe.dedupe_by_email(valid, "email", "row_id")


_SIGNUP_SCORE = sql.score(*SIGNUP_TEXTS) + " + CASE WHEN spent IS NULL THEN 0 ELSE 1 END"
_SIGNUP_COLUMNS = ", ".join(SIGNUP_TEXTS) + ", spent"
_DEDUPED_SIGNUPS = f"""WITH d0 AS (SELECT min(row_id) AS row_id, {_SIGNUP_COLUMNS} FROM signups
  GROUP BY {_SIGNUP_COLUMNS}),
d1 AS ({_best_sql("d0", "email", _SIGNUP_SCORE)}),
d2 AS ({_best_sql("d1", "mail", _SIGNUP_SCORE)})"""


@query("lead_dedupe", f"{_DEDUPED_SIGNUPS} SELECT * FROM d2", ("signups",))
def lead_dedupe(spark, sf_dir):
    """Copies, then one row per address of either column; one address holds a third of all rows."""
    return dedupe.deduplicate_leads(view(spark, sf_dir, "signups"), SIGNUPS_PROFILE)


@query("lead_survivors", f"{_DEDUPED_SIGNUPS} SELECT * FROM d2", ("signups",))
def lead_survivors(spark, sf_dir):
    """Kept up to date over four batches, the last of which comes twice: the same rows as in one go."""
    rows = view(spark, sf_dir, "signups")
    store = Survivors(spark, new_path(spark, "survivors"), SIGNUPS_PROFILE, buckets=8)
    for batch in (2, 0, 3, 1, 1):
        store.merge(rows.where(F.pmod(F.xxhash64("row_id"), F.lit(4)) == batch))
    return store.read()


@query(
    "lead_dedupe_report",
    f"""{_DEDUPED_SIGNUPS} SELECT (SELECT count(*) FROM signups) AS input_rows,
  (SELECT count(*) FROM d2) AS output_rows,
  (SELECT count(*) FROM signups) - (SELECT count(*) FROM d0) AS exact_duplicates_removed,
  (SELECT count(*) FROM d0) - (SELECT count(*) FROM d2) AS email_duplicates_removed,
  (SELECT count(*) FROM d2) AS rows_retained""",
    ("signups",),
)
def lead_dedupe_report(spark, sf_dir):
    df = view(spark, sf_dir, "signups")
    return dedupe.dedup_report(df, dedupe.deduplicate_leads(df, SIGNUPS_PROFILE))


_DUPLICATES_SQL = """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_rows,
  CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, count(*) AS distinct_rows
FROM (SELECT *, count(*) AS n FROM {source} GROUP BY ALL)"""


@query(
    "duplicate_rows_leads",
    """SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
  count(*) AS distinct_rows FROM (SELECT count(*) AS n FROM leads GROUP BY name, email, phone)""",
    ("leads",),
)
def duplicate_rows_leads(spark, sf_dir):
    return dedupe.count_duplicates(view(spark, sf_dir, "leads"), "row_id")


# --- the whole plan --------------------------------------------------------------

_CLEAN_LEADS = f"""WITH formatted AS (SELECT row_id, {sql.title('name')} AS name,
    {sql.first_word(sql.title('name'))} AS first_name,
    {sql.other_words(sql.title('name'))} AS last_name,
    lower({sql.strip('email')}) AS email, {sql.strip('phone')} AS phone FROM leads),
checked AS (SELECT *, {sql.reason('email')} AS why FROM formatted),
valid AS (SELECT * EXCLUDE (why), {sql.is_role('email')} AS is_role_email FROM checked
  WHERE why IS NULL),
kept AS ({_best_sql("valid", "email", sql.score("name", "first_name", "last_name", "email", "phone"))})"""


@query("clean_lead_list", f"{_CLEAN_LEADS} SELECT * FROM kept", ("leads",))
def clean_lead_list(spark, sf_dir):
    """Recognise, format, validate, deduplicate: the clean rows."""
    return process_leads(view(spark, sf_dir, "leads"), row_id="row_id").clean


@query(
    "rejected_lead_list",
    f"""{_CLEAN_LEADS} SELECT * EXCLUDE (why), why AS rejection_reason FROM checked
WHERE why IS NOT NULL""",
    ("leads",),
)
def rejected_lead_list(spark, sf_dir):
    return process_leads(view(spark, sf_dir, "leads"), row_id="row_id").rejected


_SIGNUP_LIST = f"""WITH formatted AS ({_FORMATTED_SIGNUPS}),
checked AS (SELECT *, coalesce({sql.reason('email')}, {sql.reason('mail')}) AS why FROM formatted),
valid AS (SELECT * EXCLUDE (why), {sql.is_role('email')} OR {sql.is_role('mail')} AS is_role_email
  FROM checked WHERE why IS NULL),
d0 AS (SELECT min(row_id) AS row_id, * EXCLUDE (row_id) FROM valid GROUP BY ALL),
d1 AS ({_best_sql("d0", "email", _SIGNUP_SCORE + " + " + sql.score("first_name", "last_name"))}),
d2 AS ({_best_sql("d1", "mail", _SIGNUP_SCORE + " + " + sql.score("first_name", "last_name"))})"""


@query("clean_signup_list", f"{_SIGNUP_LIST} SELECT * FROM d2", ("signups",))
def clean_signup_list(spark, sf_dir):
    return process_leads(view(spark, sf_dir, "signups"), row_id="row_id").clean


@query(
    "signup_list_report",
    f"""{_SIGNUP_LIST} SELECT (SELECT count(*) FROM signups) AS input_rows,
  (SELECT count(*) FROM d2) AS output_rows,
  (SELECT count(*) FROM checked WHERE why IS NOT NULL) AS rejected_rows,
  (SELECT count(DISTINCT semantic_type) FROM
    ({_profile_sql("signups", SIGNUP_TEXTS, {"spent": "double"})}) WHERE semantic_type <> 'unknown')
    AS semantic_types_detected,
  (SELECT whitespace_fixes FROM ({_CHANGES_SQL})) AS whitespace_fixes,
  (SELECT name_fields_formatted FROM ({_CHANGES_SQL})) AS name_fields_formatted,
  (SELECT email_fields_normalized FROM ({_CHANGES_SQL})) AS email_fields_normalized,
  (SELECT full_names_split FROM ({_CHANGES_SQL})) AS full_names_split,
  (SELECT count(*) FROM checked WHERE why LIKE 'INVALID%') AS invalid_email_count,
  (SELECT count(*) FROM checked WHERE why = 'BLANK_EMAIL') AS blank_email_count,
  (SELECT role_based_email_count FROM ({_report_sql("formatted", ["email", "mail"])}))
    AS role_based_email_count,
  (SELECT count(*) FROM valid) - (SELECT count(*) FROM d0) AS exact_duplicates_removed,
  (SELECT count(*) FROM d0) - (SELECT count(*) FROM d2) AS email_duplicates_removed""",
    ("signups",),
)
def signup_list_report(spark, sf_dir):
    report = process_leads(view(spark, sf_dir, "signups"), row_id="row_id").report()
    names = ("input_rows", "output_rows", "rejected_rows", "semantic_types_detected")
    flat = {n: report[n] for n in names}
    flat.update(report["formatting"])
    flat.update(
        {n: report["validation"][n] for n in (
            "invalid_email_count", "blank_email_count", "role_based_email_count")}
    )
    flat.update(
        {n: report["deduplication"][n] for n in (
            "exact_duplicates_removed", "email_duplicates_removed")}
    )
    schema = ", ".join(f"{n} BIGINT" for n in flat)
    return spark.createDataFrame([tuple(flat.values())], schema)
