"""Queries on any table: frequencies, profiles, quality issues, score, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import table, view
from tablecare.functions.columns import nan_as_null
from tablecare.operators import frequencies, profile, quality, sketches
from tablecare.plans.profile_state import ProfileState
from tablecare.sources.staging import new_path
from tablecare.operators.dedupe import count_duplicates, count_duplicates_by_digest
from tablecare.operators.profile import TableFacts

# Column -> (type as shown, family) of the tables profiled here.
DIRTY = {
    "l_orderkey": ("bigint", "numeric"), "l_linenumber": ("int", "numeric"),
    "quantity": ("double", "numeric"), "returnflag": ("string", "string"),
    "sparse_price": ("double", "numeric"), "constant_col": ("string", "string"),
    "l_shipdate": ("timestamp_ntz", "datetime"),
}
EVENTS = {
    "event_id": ("bigint", "numeric"), "amount": ("double", "numeric"), "kind": ("string", "string"),
    "is_big": ("boolean", "boolean"), "seen_at": ("timestamp_ntz", "datetime"),
    "code": ("string", "string"), "nothing": ("string", "string"),
}
ORDERS = {
    "o_orderkey": ("bigint", "numeric"), "o_custkey": ("bigint", "numeric"),
    "o_orderstatus": ("string", "string"), "o_totalprice": ("double", "numeric"),
    "o_orderdate": ("timestamp_ntz", "datetime"), "o_orderpriority": ("string", "string"),
}
CUSTOMER = {
    "c_custkey": ("bigint", "numeric"), "c_name": ("string", "string"),
    "c_nationkey": ("int", "numeric"), "c_acctbal": ("double", "numeric"),
    "c_mktsegment": ("string", "string"),
}

_NUMBER = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def facts_sql(source: str, columns: dict) -> str:
    """One row per column with every fact that the rules look at."""
    parts = []
    for place, (c, (dtype, family)) in enumerate(columns.items()):
        if family == "numeric":
            quartile = {p: f"quantile_cont({c}::DOUBLE, {p})" for p in (0.25, 0.5, 0.75)}
            numeric = (
                f"avg({c}::DOUBLE) AS mean, {quartile[0.5]} AS median, min({c})::DOUBLE AS lo, "
                f"max({c})::DOUBLE AS hi, {quartile[0.25]} AS q1, {quartile[0.75]} AS q3"
            )
            fence = f"SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM {source}"
            wild = (
                f"(SELECT count(*) FROM {source}, ({fence}) AS f "
                f"WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))"
            )
        else:
            numeric = ", ".join(
                f"NULL::DOUBLE AS {n}" for n in ("mean", "median", "lo", "hi", "q1", "q3")
            )
            wild = "0::BIGINT"
        numbers = (
            f"count(*) FILTER (regexp_matches(trim({c}), {_NUMBER}))" if family == "string" else "0::BIGINT"
        )
        mode = (
            f"(SELECT {c}::VARCHAR FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)" if family != "numeric" else "NULL::VARCHAR"
        )
        parts.append(
            f"SELECT {place} AS place, '{c}' AS \"column\", '{dtype}' AS dtype, '{family}' AS family, "
            f"count(*) AS total, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
            f"count(DISTINCT {c}) AS uniq, {numeric}, {wild} AS wild, {numbers} AS numbers, "
            f"{mode} AS mode FROM {source}"
        )
    return " UNION ALL ".join(parts)


_TYPE = """CASE WHEN non_null = 0 THEN 'empty' WHEN family = 'numeric' THEN 'numeric'
  WHEN uniq / non_null > 0.9 THEN 'identifier' WHEN uniq <= 20 THEN 'categorical'
  ELSE 'freetext' END"""

_PROFILE = f"""SELECT "column", dtype, {_TYPE} AS inferred_type, total, non_null, null_count,
  round(null_count / total * 100, 2) AS null_pct, uniq AS "unique",
  round(mean, 6) AS mean, median, lo AS min, hi AS max"""


def _copies(source: str) -> str:
    return (
        "(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) "
        f"FROM (SELECT *, count(*) AS n FROM {source} GROUP BY ALL))"
    )


# --- frequencies and profile -------------------------------------------------------


@query(
    "value_frequencies",
    """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, NULL::DOUBLE AS number,
  count(*) AS n FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, o_custkey::DOUBLE, count(*) FROM orders GROUP BY o_custkey
UNION ALL SELECT 'o_orderpriority', o_orderpriority, NULL::DOUBLE, count(*) FROM orders
GROUP BY o_orderpriority""",
)
def value_frequencies(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return frequencies.value_frequencies(orders, ["o_orderstatus", "o_custkey", "o_orderpriority"])


@query(
    "profile_nulls",
    f"""WITH facts AS ({facts_sql("lineitem_dirty", DIRTY)})
SELECT "column", total, non_null, null_count FROM facts""",
    ("lineitem_dirty",),
)
def profile_nulls(spark, sf_dir):
    found = profile.profile_table(view(spark, sf_dir, "lineitem_dirty"))
    return found.select("column", "total", "non_null", "null_count")


def _unique_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"unique\" FROM {source}" for c in columns
    )


@query("profile_unique", _unique_sql("lineitem_dirty", DIRTY), ("lineitem_dirty",))
def profile_unique(spark, sf_dir):
    return frequencies.unique_counts(view(spark, sf_dir, "lineitem_dirty"))


@query("profile_unique_documents", _unique_sql("documents", ("doc_id", "text", "lang", "source", "n_chars")))
def profile_unique_documents(spark, sf_dir):
    return frequencies.unique_counts(table(spark, sf_dir, "documents"))


@query(
    "profile_unique_embeddings",
    _unique_sql("embeddings", ("vec_id", "embedding", "label")),
)
def profile_unique_embeddings(spark, sf_dir):
    """Nested columns count too."""
    return frequencies.unique_counts(table(spark, sf_dir, "embeddings"))


@query(
    "profile_modes",
    """SELECT 'returnflag' AS "column", (SELECT returnflag FROM lineitem_dirty WHERE returnflag IS NOT NULL
  GROUP BY returnflag ORDER BY count(*) DESC, returnflag LIMIT 1) AS mode
UNION ALL SELECT 'constant_col', (SELECT constant_col FROM lineitem_dirty
  GROUP BY constant_col ORDER BY count(*) DESC, constant_col LIMIT 1)""",
    ("lineitem_dirty",),
)
def profile_modes(spark, sf_dir):
    return frequencies.modes(view(spark, sf_dir, "lineitem_dirty"), ["returnflag", "constant_col"])


@query(
    "profile_numeric",
    f"""WITH facts AS ({facts_sql("lineitem_dirty", DIRTY)})
SELECT "column", round(mean, 6) AS mean, median, lo AS min, hi AS max FROM facts
WHERE family = 'numeric'""",
    ("lineitem_dirty",),
)
def profile_numeric(spark, sf_dir):
    found = profile.profile_table(view(spark, sf_dir, "lineitem_dirty"))
    return found.filter("inferred_type = 'numeric'").select(
        "column", F.round("mean", 6).alias("mean"), "median", "min", "max"
    )


@query(
    "profile_types",
    f"""WITH facts AS ({facts_sql("event_log", EVENTS)})
SELECT "column", {_TYPE} AS inferred_type FROM facts""",
    ("event_log",),
)
def profile_types(spark, sf_dir):
    return profile.profile_table(view(spark, sf_dir, "event_log")).select("column", "inferred_type")


@query(
    "profile_types_approximate",
    f"""WITH facts AS ({facts_sql("event_log", EVENTS)})
SELECT "column", {_TYPE} AS inferred_type FROM facts""",
    ("event_log",),
)
def profile_types_approximate(spark, sf_dir):
    """Sketches decide where their bounds allow it, counts elsewhere: the same types."""
    return sketches.approximate_types(view(spark, sf_dir, "event_log")).select("column", "inferred_type")


def _profile_query(name, source, columns, load):
    @query(
        f"profile_table_{name}",
        f"WITH facts AS ({facts_sql(source, columns)}) {_PROFILE} FROM facts",
        (source,) if load is view else (),
    )
    def run(spark, sf_dir):
        return profile.profile_table(load(spark, sf_dir, source)).withColumn("mean", F.round("mean", 6))


_profile_query("lineitem_dirty", "lineitem_dirty", DIRTY, view)
_profile_query("event_log", "event_log", EVENTS, view)
_profile_query("orders", "orders", ORDERS, table)
_profile_query("customer", "customer", CUSTOMER, table)


@query(
    "profile_table_grown",
    f"WITH facts AS ({facts_sql('event_log', EVENTS)}) {_PROFILE} FROM facts",
    ("event_log",),
)
def profile_table_grown(spark, sf_dir):
    """From what five additions counted, one of which came twice: as if from the whole table."""
    rows = view(spark, sf_dir, "event_log")
    state = ProfileState(spark, new_path(spark, "profile-state"))
    for k in (0, 1, 2, 3, 4, 2):
        state.add(f"batch {k}", rows.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == k))
    return profile.profile_table(state.facts()).withColumn("mean", F.round("mean", 6))


@query(
    "profile_quantiles_narrowed",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", quantile_cont({c}::DOUBLE, 0.25) AS q1,
  quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM lineitem"""
        for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def profile_quantiles_narrowed(spark, sf_dir):
    """Exact quartiles from counted values, dealt out by ranges."""
    names = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = nan_as_null(table(spark, sf_dir, "lineitem").select(names))
    found = frequencies.distinct_facts(df, names, [0.25, 0.5, 0.75])
    # Exact quantiles are int or Decimal; columns without values have none.
    quartiles = {n: map(float, f["quantiles"]) for n, f in found.items()}
    return spark.createDataFrame(
        [(n, *quartiles.get(n, (None,) * 3)) for n in names], "column STRING, q1 DOUBLE, median DOUBLE, q3 DOUBLE"
    )


@query(
    "duplicate_rows",
    """SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
  count(*) AS distinct_rows FROM (SELECT *, count(*) AS n FROM lineitem_dirty GROUP BY ALL)""",
    ("lineitem_dirty",),
)
def duplicate_rows(spark, sf_dir):
    return count_duplicates(view(spark, sf_dir, "lineitem_dirty"))


@query(
    "duplicate_rows_by_digest",
    """SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
  count(*) AS distinct_rows FROM (SELECT *, count(*) AS n FROM lineitem_dirty GROUP BY ALL)""",
    ("lineitem_dirty",),
)
def duplicate_rows_by_digest(spark, sf_dir):
    """Digests of rows are shuffled, whole rows only where those are alike."""
    return count_duplicates_by_digest(view(spark, sf_dir, "lineitem_dirty"))


# --- quality issues ----------------------------------------------------------------

_MISSING = """SELECT "column", 'missing_values' AS "check",
  CASE WHEN round(null_count / total * 100, 2) > 30 THEN 'critical' ELSE 'warning' END AS severity,
  null_count::VARCHAR || ' of ' || total::VARCHAR || ' values are absent' AS message,
  null_count AS affected FROM facts WHERE round(null_count / total * 100, 2) > 5"""
_CONSTANT = """SELECT "column", 'constant_column' AS "check", 'warning' AS severity,
  'no two values differ, so nothing can be learned from it' AS message, total AS affected
FROM facts WHERE uniq <= 1"""
_CARDINALITY = f"""SELECT "column", 'high_cardinality' AS "check", 'info' AS severity,
  uniq::VARCHAR || ' categories are many' AS message, uniq AS affected
FROM facts WHERE {_TYPE} = 'categorical' AND uniq > {{least}}"""
_OUTLIERS = """SELECT "column", 'outliers' AS "check", 'warning' AS severity,
  wild::VARCHAR || ' values lie more than 1.5 interquartile ranges outside the quartiles' AS message,
  wild AS affected FROM facts WHERE wild > 0"""


def _duplicates(source: str) -> str:
    return f"""SELECT 'all columns' AS "column", 'duplicates' AS "check", 'warning' AS severity,
  n::VARCHAR || ' rows are copies of other rows' AS message, n AS affected
FROM (SELECT {_copies(source)} AS n) WHERE n > 0"""


def _issues(source: str) -> str:
    return " UNION ALL ".join([_MISSING, _duplicates(source), _CONSTANT, _CARDINALITY.format(least=50), _OUTLIERS])


def _issue_query(name, source, columns, body, checks=None, load=view, config=None):
    @query(
        name,
        f"WITH facts AS ({facts_sql(source, columns)}) {body}",
        (source,) if load is view else (),
    )
    def run(spark, sf_dir):
        return quality.run_quality_checks(load(spark, sf_dir, source), config, checks)


_LINES = ("lineitem_dirty", DIRTY)
_issue_query("quality_missing", *_LINES, _MISSING, ("missing_values",))
_issue_query("quality_duplicates", *_LINES, _duplicates("lineitem_dirty"), ("duplicates",))
_issue_query("quality_constant", *_LINES, _CONSTANT, ("constant_column",))
# Three return flags are many where two are allowed.
_issue_query(
    "quality_high_cardinality", *_LINES, _CARDINALITY.format(least=2), ("high_cardinality",),
    config={"high_cardinality_min_unique": 2},
)
_issue_query("quality_outliers", *_LINES, _OUTLIERS, ("outliers",))
_issue_query("quality_issues", *_LINES, _issues("lineitem_dirty"))
_issue_query("quality_issues_event_log", "event_log", EVENTS, _issues("event_log"))
_issue_query("quality_issues_orders", "orders", ORDERS, _issues("orders"), load=table)


@query(
    "quality_summary",
    f"""WITH facts AS ({facts_sql("event_log", EVENTS)}), issues AS ({_issues("event_log")})
SELECT count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info,
  count(*) AS total FROM issues""",
    ("event_log",),
)
def quality_summary(spark, sf_dir):
    return quality.quality_summary(quality.run_quality_checks(view(spark, sf_dir, "event_log")))


# --- score -------------------------------------------------------------------------


def _score_sql(source: str) -> str:
    return f"""SELECT
  least(sum(null_count)::DOUBLE / (max(total) * count(*)) * 100 * 0.4, 40.0::DOUBLE) AS missing_penalty,
  least({_copies(source)} / max(total) * 100 * 0.2, 20.0::DOUBLE) AS duplicates_penalty,
  least(count(*) FILTER (uniq <= 1) * 5.0::DOUBLE, 20.0::DOUBLE) AS constant_penalty,
  least(count(*) FILTER (wild > 0 AND non_null >= 4) * 3.0::DOUBLE, 15.0::DOUBLE) AS outliers_penalty
FROM facts"""


_SCORED = """SELECT round(greatest(100 - missing_penalty - duplicates_penalty - constant_penalty
  - outliers_penalty, 0), 2) AS score, * FROM penalties"""
_LABEL = """CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good'
  WHEN score >= 50 THEN 'Moderate' ELSE 'Poor' END"""


def _score_query(name, source, columns, load):
    @query(
        name,
        f"""WITH facts AS ({facts_sql(source, columns)}), penalties AS ({_score_sql(source)}),
scored AS ({_SCORED})
SELECT score, {_LABEL} AS grade, round(missing_penalty, 6) AS missing_penalty,
  round(duplicates_penalty, 6) AS duplicates_penalty, constant_penalty, outliers_penalty
FROM scored""",
        (source,) if load is view else (),
    )
    def run(spark, sf_dir):
        rounded = {n: F.round(n, 6) for n in ("missing_penalty", "duplicates_penalty")}
        return quality.quality_score(load(spark, sf_dir, source)).withColumns(rounded)


_score_query("quality_score", "lineitem_dirty", DIRTY, view)
_score_query("quality_score_event_log", "event_log", EVENTS, view)
_score_query("quality_score_customer", "customer", CUSTOMER, table)


@query(
    "quality_grades",
    f"""SELECT c_custkey, {_LABEL} AS grade,
  CASE WHEN critical > 0 THEN 'CRITICAL' WHEN score >= 95 THEN 'A+ (Excellent)'
    WHEN score >= 90 THEN 'A (Very Good)' WHEN score >= 80 THEN 'B (Good)'
    WHEN score >= 70 THEN 'C (Fair)' WHEN score >= 60 THEN 'D (Poor)' ELSE 'F (Critical)' END
    AS report_grade,
  CASE WHEN critical > 0 THEN 'ACTION REQUIRED' WHEN score >= 90 THEN 'HEALTHY'
    WHEN score >= 80 THEN 'REVIEW' ELSE 'NEEDS ATTENTION' END AS report_status
FROM (SELECT c_custkey, c_custkey % 101 AS score, CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END
  AS critical FROM customer)""",
)
def quality_grades(spark, sf_dir):
    """Label, report grade and report status for every score that can be."""
    scores = table(spark, sf_dir, "customer").select(
        "c_custkey",
        (F.col("c_custkey") % 101).alias("score"),
        F.when(F.col("c_nationkey") == 3, 1).otherwise(0).alias("critical"),
    )
    graded = quality.grade_columns(F.col("score"), F.col("critical"))
    return scores.select("c_custkey", *[c.alias(n) for n, c in graded.items()])


# --- suggestions -------------------------------------------------------------------

_PCT = "printf('%.1f', null_count / total * 100)"
_FENCES = "printf('%.2f', q1 - 1.5 * (q3 - q1)) || ' to ' || printf('%.2f', q3 + 1.5 * (q3 - q1))"
_RULES = {
    "missing_values": f"""SELECT 1 AS rule, place, 'missing_values' AS type,
  CASE WHEN null_count / total * 100 > 40 THEN 'high' WHEN null_count / total * 100 > 10
    THEN 'medium' ELSE 'low' END AS severity, "column" AS scope,
  {_PCT} || ' % of ' || "column" || ' is absent' AS message,
  'Put ' || CASE WHEN family = 'numeric' THEN 'its median, or its mean if both tails are alike'
    WHEN mode IS NULL THEN 'a word of their own'
    ELSE 'its commonest value (' || CASE WHEN family = 'boolean' THEN upper(mode[1]) || mode[2:] ELSE mode END
      || ') or a word of their own' END || ' into the ' || null_count::VARCHAR || ' gaps.' AS action
FROM facts WHERE null_count > 0""",
    "duplicates": """SELECT 2 AS rule, 0 AS place, 'duplicates' AS type,
  CASE WHEN n / total * 100 > 10 THEN 'high' ELSE 'medium' END AS severity, 'dataset' AS scope,
  printf('%.1f', n / total * 100) || ' % of the rows are copies' AS message,
  'Keep one of each and let ' || n::VARCHAR || ' rows go.' AS action
FROM (SELECT {copies} AS n, max(total) AS total FROM facts) WHERE n > 0""",
    "constant_column": """SELECT 3 AS rule, place, 'constant_column' AS type, 'medium' AS severity,
  "column" AS scope, "column" || ' is the same in every row' AS message,
  'Leave ' || "column" || ' out.' AS action FROM facts WHERE uniq <= 1""",
    "outliers": f"""SELECT 4 AS rule, place, 'outliers' AS type, 'medium' AS severity,
  "column" AS scope, wild::VARCHAR || ' values of ' || "column" || ' lie outside ' || {_FENCES} AS message,
  'Look at them, or limit ' || "column" || ' to ' || {_FENCES} || '.' AS action
FROM facts WHERE wild > 0 AND non_null >= 4""",
    "type_conversion": """SELECT 5 AS rule, place, 'type_conversion' AS type, 'low' AS severity,
  "column" AS scope, printf('%.0f', numbers / non_null * 100) || ' % of the texts in ' || "column"
    || ' are numbers' AS message, 'Store ' || "column" || ' as numbers.' AS action
FROM facts WHERE family = 'string' AND non_null > 0 AND numbers / non_null >= 0.8""",
    "high_cardinality": """SELECT 6 AS rule, place, 'high_cardinality' AS type, 'low' AS severity,
  "column" AS scope, "column" || ' has ' || uniq::VARCHAR || ' different texts that recur' AS message,
  'Merge rare ones, or code them by how often or with what result they occur.' AS action
FROM facts WHERE family = 'string' AND non_null > 0 AND uniq > 50 AND uniq / non_null < 0.9""",
}


def _suggest_query(name, source, columns, rules=None, load=view):
    found = " UNION ALL ".join(_RULES[k] for k in rules or _RULES).replace("{copies}", _copies(source))
    rank = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"

    @query(
        name,
        f"""WITH facts AS ({facts_sql(source, columns)}), found AS ({found})
SELECT row_number() OVER (ORDER BY {rank}, rule, place) AS place, type, severity, scope, message,
  action FROM found""",
        (source,) if load is view else (),
    )
    def run(spark, sf_dir):
        return quality.suggest(load(spark, sf_dir, source), rules)


_suggest_query("suggest_missing", *_LINES, ("missing_values",))
_suggest_query("suggest_duplicates", *_LINES, ("duplicates",))
_suggest_query("suggest_constant", *_LINES, ("constant_column",))
_suggest_query("suggest_outliers", *_LINES, ("outliers",))
_suggest_query("suggest_type_conversion", "event_log", EVENTS, ("type_conversion",))
_suggest_query("suggest_high_cardinality", "event_log", EVENTS, ("high_cardinality",))
_suggest_query("suggestions", *_LINES)
_suggest_query("suggestions_event_log", "event_log", EVENTS)
_suggest_query("suggestions_customer", "customer", CUSTOMER, load=table)


@query(
    "table_facts_reused",
    f"""WITH facts AS ({facts_sql("lineitem_dirty", DIRTY)}), penalties AS ({_score_sql("lineitem_dirty")}),
scored AS ({_SCORED}), issues AS ({_issues("lineitem_dirty")})
SELECT score, (SELECT count(*) FROM issues) AS issues,
  {_copies("lineitem_dirty")} AS duplicate_rows FROM scored""",
    ("lineitem_dirty",),
)
def table_facts_reused(spark, sf_dir):
    """Issues and score from one set of facts."""
    facts = TableFacts(view(spark, sf_dir, "lineitem_dirty"))
    issues = quality.quality_issues(facts)
    row = (quality.score_of(facts)["score"], len(issues), facts.duplicate_rows)
    return spark.createDataFrame([row], "score DOUBLE, issues BIGINT, duplicate_rows BIGINT")
