"""Queries on cleaning, coercion, report tables and the whole audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.profiles import CUSTOMER, DIRTY, EVENTS, _SCORED, _score_sql, facts_sql
from catalog.registry import query
from catalog.views import table, view
from tablecare.operators import clean as cleaning
from tablecare.operators import report
from tablecare.operators.coerce import coerce_types
from tablecare.plans.audit import audit_table

_MEDIAN = "(SELECT quantile_cont({c}::DOUBLE, 0.5) FROM {t})"
_MODE = """(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""


def _median(c, t):
    return f"coalesce({c}::DOUBLE, {_MEDIAN.format(c=c, t=t)})"


def _mode(c, t):
    return f"coalesce({c}, {_MODE.format(c=c, t=t)})"


def _missing(source, config, names):
    def run(spark, sf_dir):
        done = cleaning.handle_missing(view(spark, sf_dir, source), config)
        return done.df.select(*names)

    return run


# --- dropping columns --------------------------------------------------------------


@query(
    "clean_dropped_columns",
    """SELECT 'l_linenumber' AS "column", 'force_drop' AS reason
UNION ALL SELECT 'sparse_price',
  printf('%.1f', (count(*) - count(sparse_price)) / count(*) * 100) || ' % absent, more than 60 %'
  FROM lineitem_dirty HAVING (count(*) - count(sparse_price)) / count(*) > 0.6
UNION ALL SELECT 'constant_col', 'single_unique_value' FROM lineitem_dirty
  HAVING count(DISTINCT constant_col) <= 1 AND count(*) >= 10""",
    ("lineitem_dirty",),
)
def clean_dropped_columns(spark, sf_dir):
    cfg = {"force_drop_columns": ("l_linenumber", "no_such_column")}
    done = cleaning.filter_columns(view(spark, sf_dir, "lineitem_dirty"), cfg)
    return done.dropped_df(spark)


@query(
    "clean_drop_columns",
    "SELECT l_orderkey, l_linenumber, quantity, returnflag, l_shipdate FROM lineitem_dirty",
    ("lineitem_dirty",),
)
def clean_drop_columns(spark, sf_dir):
    return cleaning.filter_columns(view(spark, sf_dir, "lineitem_dirty")).df


@query(
    "clean_force_drop",
    "SELECT quantity, returnflag, sparse_price, constant_col, l_shipdate FROM lineitem_dirty",
    ("lineitem_dirty",),
)
def clean_force_drop(spark, sf_dir):
    cfg = {
        "force_drop_columns": ("L_ORDERKEY", "l_linenumber"),
        "null_drop_threshold": 0.99,
        "drop_single_value_columns": False,
    }
    return cleaning.filter_columns(view(spark, sf_dir, "lineitem_dirty"), cfg).df


# --- missing values ----------------------------------------------------------------

_KEYS = ("l_orderkey", "l_linenumber")


@query(
    "impute_median",
    f"SELECT l_orderkey, l_linenumber, {_median('quantity', 'lineitem_dirty')} AS quantity FROM lineitem_dirty",
    ("lineitem_dirty",),
)
def impute_median(spark, sf_dir):
    return _missing("lineitem_dirty", None, (*_KEYS, "quantity"))(spark, sf_dir)


@query(
    "impute_mean",
    """SELECT l_orderkey, l_linenumber,
  round(coalesce(quantity, (SELECT avg(quantity) FROM lineitem_dirty)), 6) AS quantity FROM lineitem_dirty""",
    ("lineitem_dirty",),
)
def impute_mean(spark, sf_dir):
    done = _missing("lineitem_dirty", {"numeric_strategy": "mean"}, (*_KEYS, "quantity"))
    return done(spark, sf_dir).withColumn("quantity", F.round("quantity", 6))


@query(
    "impute_median_exact",
    """WITH big AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 1152921504606846976 + o_orderkey END AS x FROM orders),
placed AS (SELECT x, row_number() OVER (ORDER BY x) AS nth, count(*) OVER () AS n FROM big WHERE x IS NOT NULL),
middle AS (SELECT min(x) AS low, max(x) AS high FROM placed WHERE nth IN ((n + 1) // 2, n // 2 + 1))
SELECT id, coalesce(x::VARCHAR || '.0000', (SELECT ((low::HUGEINT + high) // 2)::VARCHAR ||
  CASE WHEN (low::HUGEINT + high) % 2 = 0 THEN '.0000' ELSE '.5000' END FROM middle)) AS x FROM big""",
)
def impute_median_exact(spark, sf_dir):
    """Whole numbers beyond 2**53 keep their last digits, and so does their median."""
    key = F.col("o_orderkey")
    x = F.when(key % 7 != 0, F.lit(2**60) + key).alias("x")
    done = cleaning.handle_missing(table(spark, sf_dir, "orders").select(key.alias("id"), x))
    return done.df.withColumn("x", F.col("x").cast("string"))


@query(
    "impute_constant",
    """SELECT l_orderkey, l_linenumber, coalesce(quantity, -1) AS quantity,
  coalesce(returnflag, 'Unknown') AS returnflag FROM lineitem_dirty""",
    ("lineitem_dirty",),
)
def impute_constant(spark, sf_dir):
    cfg = {
        "numeric_strategy": "constant", "categorical_strategy": "constant", "numeric_fill_value": -1,
    }
    return _missing("lineitem_dirty", cfg, (*_KEYS, "quantity", "returnflag"))(spark, sf_dir)


@query(
    "impute_mode",
    f"SELECT l_orderkey, l_linenumber, {_mode('returnflag', 'lineitem_dirty')} AS returnflag FROM lineitem_dirty",
    ("lineitem_dirty",),
)
def impute_mode(spark, sf_dir):
    return _missing("lineitem_dirty", None, (*_KEYS, "returnflag"))(spark, sf_dir)


@query(
    "impute_mode_boolean",
    f"""SELECT event_id, {_mode('is_big', 'event_log')} AS is_big, {_mode('kind', 'event_log')} AS kind
FROM event_log""",
    ("event_log",),
)
def impute_mode_boolean(spark, sf_dir):
    cfg = {"datetime_strategy": "flag"}
    return _missing("event_log", cfg, ("event_id", "is_big", "kind"))(spark, sf_dir)


@query(
    "flag_nulls",
    """SELECT event_id, amount, kind, is_big, amount IS NULL AS amount__was_null,
  kind IS NULL AS kind__was_null, is_big IS NULL AS is_big__was_null,
  seen_at IS NULL AS seen_at__was_null FROM event_log""",
    ("event_log",),
)
def flag_nulls(spark, sf_dir):
    cfg = dict.fromkeys(("numeric_strategy", "categorical_strategy", "datetime_strategy"), "flag")
    flags = [f"{n}__was_null" for n in ("amount", "kind", "is_big", "seen_at")]
    return _missing("event_log", cfg, ("event_id", "amount", "kind", "is_big", *flags))(spark, sf_dir)


@query(
    "drop_null_rows",
    """SELECT event_id, amount, kind, is_big, code FROM event_log
WHERE amount IS NOT NULL AND kind IS NOT NULL AND is_big IS NOT NULL AND seen_at IS NOT NULL""",
    ("event_log",),
)
def drop_null_rows(spark, sf_dir):
    cfg = dict.fromkeys(("numeric_strategy", "categorical_strategy"), "drop_rows")
    return _missing("event_log", cfg, ("event_id", "amount", "kind", "is_big", "code"))(spark, sf_dir)


@query(
    "drop_then_impute",
    f"""WITH kept AS (SELECT * FROM event_log WHERE amount IS NOT NULL)
SELECT event_id, amount, {_mode('kind', 'kept')} AS kind, {_mode('is_big', 'kept')} AS is_big
FROM kept WHERE seen_at IS NOT NULL""",
    ("event_log",),
)
def drop_then_impute(spark, sf_dir):
    """Modes are taken from the rows that dropping by the numbers has left."""
    cfg = {"numeric_strategy": "drop_rows"}
    return _missing("event_log", cfg, ("event_id", "amount", "kind", "is_big"))(spark, sf_dir)


@query(
    "missing_actions",
    """SELECT 'amount' AS "column", 'drop_rows' AS action, NULL::VARCHAR AS fill_value,
  NULL::BIGINT AS nulls_filled, count(*) FILTER (amount IS NULL) AS rows_removed,
  NULL::VARCHAR AS indicator_column, NULL::VARCHAR AS reason FROM event_log
UNION ALL SELECT 'kind', 'drop_rows', NULL, NULL,
  count(*) FILTER (amount IS NOT NULL AND kind IS NULL), NULL, NULL FROM event_log
UNION ALL SELECT 'is_big', 'drop_rows', NULL, NULL,
  count(*) FILTER (amount IS NOT NULL AND kind IS NOT NULL AND is_big IS NULL), NULL, NULL FROM event_log
UNION ALL SELECT 'nothing', 'skipped', NULL, NULL, NULL, NULL, 'null_ratio_too_high'
UNION ALL SELECT 'seen_at', 'flagged', NULL, NULL, NULL, 'seen_at__was_null', NULL""",
    ("event_log",),
)
def missing_actions(spark, sf_dir):
    cfg = {
        "numeric_strategy": "drop_rows", "categorical_strategy": "drop_rows",
        "datetime_strategy": "flag",
    }
    return cleaning.handle_missing(view(spark, sf_dir, "event_log"), cfg).actions_df(spark)


_CLEAN_LINES = f"""SELECT l_orderkey, l_linenumber, {_median('quantity', 'lineitem_dirty')} AS quantity,
  {_mode('returnflag', 'lineitem_dirty')} AS returnflag, l_shipdate FROM lineitem_dirty"""


@query("clean_table", _CLEAN_LINES, ("lineitem_dirty",))
def clean_table(spark, sf_dir):
    return cleaning.clean(view(spark, sf_dir, "lineitem_dirty")).df


_CLEAN_EVENTS = f"""SELECT event_id, {_median('amount', 'event_log')} AS amount,
  {_mode('kind', 'event_log')} AS kind, {_mode('is_big', 'event_log')} AS is_big, seen_at, code
FROM event_log WHERE seen_at IS NOT NULL"""


@query("clean_table_event_log", _CLEAN_EVENTS, ("event_log",))
def clean_table_event_log(spark, sf_dir):
    return cleaning.clean(view(spark, sf_dir, "event_log")).df


# What cleaning keeps, and why it drops the rest, from the facts about each column.
_KEPT = "SELECT * FROM facts WHERE null_count / total <= 0.6 AND (uniq > 1 OR total < 10)"


@query(
    "clean_log",
    f"""WITH facts AS ({facts_sql("event_log", EVENTS)}), kept AS ({_KEPT})
SELECT "column" || ' left out: ' || CASE WHEN null_count / total > 0.6
  THEN printf('%.1f', null_count / total * 100) || ' % absent, more than 60 %' ELSE 'single_unique_value' END AS line
FROM facts WHERE "column" NOT IN (SELECT "column" FROM kept)
UNION ALL SELECT "column" || ': ' || CASE family WHEN 'numeric' THEN 'filled_median'
  WHEN 'datetime' THEN 'drop_rows' ELSE 'filled_mode' END FROM kept WHERE null_count > 0""",
    ("event_log",),
)
def clean_log(spark, sf_dir):
    lines = cleaning.clean(view(spark, sf_dir, "event_log")).log()
    return spark.createDataFrame([(line,) for line in lines], "line STRING")


# --- coercion ----------------------------------------------------------------------


def _coerced(*names, config=None, source="coerce_src"):
    def run(spark, sf_dir):
        return coerce_types(view(spark, sf_dir, source), config).df.select(*names)

    return run


_BOOL = "CASE WHEN lower(trim(b)) IN ('true', 'yes', '1', 'y') THEN true WHEN b IS NOT NULL THEN false END"
_WHOLE = "TRY_CAST(TRY_CAST(trim(n) AS DOUBLE) AS BIGINT)"
_TIME = "try_strptime(ts, '%Y-%m-%d')"


@query("coerce_bool", f"SELECT id, {_BOOL} AS b FROM coerce_src", ("coerce_src",))
def coerce_bool(spark, sf_dir):
    return _coerced("id", "b")(spark, sf_dir)


@query(
    "coerce_number",
    f"SELECT id, {_WHOLE} AS n, TRY_CAST(x AS DOUBLE) AS x FROM coerce_src",
    ("coerce_src",),
)
def coerce_number(spark, sf_dir):
    return _coerced("id", "n", "x")(spark, sf_dir)


@query("coerce_timestamp", f"SELECT id, {_TIME} AS ts FROM coerce_src", ("coerce_src",))
def coerce_timestamp(spark, sf_dir):
    """Dates without a zone stay that."""
    return _coerced("id", "ts")(spark, sf_dir)


_COERCED = f"""SELECT id, {_BOOL} AS b, {_WHOLE} AS n, TRY_CAST(x AS DOUBLE) AS x, {_TIME} AS ts,
  try_strptime(d, '%d/%m/%Y') AS d, w, z FROM coerce_src"""


@query("coerce_table", _COERCED, ("coerce_src",))
def coerce_table(spark, sf_dir):
    return _coerced("id", "b", "n", "x", "ts", "d", "w", "z")(spark, sf_dir)


@query(
    "coerce_nothing",
    f"SELECT id, {_BOOL} AS b, n, ts FROM coerce_src",
    ("coerce_src",),
)
def coerce_nothing(spark, sf_dir):
    """Numbers and times switched off, booleans left on."""
    cfg = {"coerce_to_numeric": False, "coerce_to_datetime": False}
    return _coerced("id", "b", "n", "ts", config=cfg)(spark, sf_dir)


def _rate(parsed, c):
    return f"(SELECT count({parsed})::DOUBLE / count({c}) FROM coerce_src)"


_CHANGES = f"""SELECT 'b' AS "column", 'string' AS from_dtype, 'boolean' AS to_dtype,
  'bool' AS cast_type, 1.0::DOUBLE AS success_rate
UNION ALL SELECT 'n', 'string', 'bigint', 'numeric', {_rate("TRY_CAST(trim(n) AS DOUBLE)", "n")}
UNION ALL SELECT 'x', 'string', 'double', 'numeric', {_rate("TRY_CAST(x AS DOUBLE)", "x")}
UNION ALL SELECT 'ts', 'string', 'timestamp_ntz', 'datetime', {_rate(_TIME, "ts")}
UNION ALL SELECT 'd', 'string', 'timestamp_ntz', 'datetime', {_rate("try_strptime(d, '%d/%m/%Y')", "d")}"""


@query("coerce_log", _CHANGES, ("coerce_src",))
def coerce_log(spark, sf_dir):
    return coerce_types(view(spark, sf_dir, "coerce_src")).changes_df(spark)


_NUM = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


@query(
    "coerce_attempts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'numeric' AS cast_type, count({c}) AS non_null,
  count(*) FILTER (regexp_matches(trim({c}), {_NUM})) AS parsed,
  count(*) FILTER (regexp_matches(trim({c}), {_NUM})) / count({c}) >= 0.95 AS accepted FROM coerce_src"""
        for c in ("n", "x", "ts", "d", "w")
    ),
    ("coerce_src",),
)
def coerce_attempts(spark, sf_dir):
    """What was tried as a number, with what result; column b never got that far."""
    tried = coerce_types(view(spark, sf_dir, "coerce_src")).attempts_df(spark)
    return tried.filter("cast_type = 'numeric'")


@query(
    "coerce_by_type",
    f"""SELECT cast_type, array_to_string(list_sort(list("column")), ',') AS columns,
  count(*) AS n_columns FROM ({_CHANGES}) GROUP BY cast_type""",
    ("coerce_src",),
)
def coerce_by_type(spark, sf_dir):
    changes = coerce_types(view(spark, sf_dir, "coerce_src")).changes_df(spark)
    return report.casts_by_type(changes).withColumn("columns", F.array_join("columns", ","))


# --- report tables and the whole audit ---------------------------------------------

_AUDITED_LINES = _CLEAN_LINES


@query("audit_clean_lineitem", _AUDITED_LINES, ("lineitem_dirty",))
def audit_clean_lineitem(spark, sf_dir):
    return audit_table(view(spark, sf_dir, "lineitem_dirty")).clean_df


# code is text: 7 of 8 values are numbers, too few to cast.
@query("audit_clean_event_log", _CLEAN_EVENTS, ("event_log",))
def audit_clean_event_log(spark, sf_dir):
    return audit_table(view(spark, sf_dir, "event_log")).clean_df


@query(
    "audit_clean_coerce_src",
    f"""SELECT id, {_BOOL} AS b, {_WHOLE} AS n,
  TRY_CAST({_mode('x', 'coerce_src')} AS DOUBLE) AS x, {_TIME} AS ts,
  try_strptime(d, '%d/%m/%Y') AS d, w FROM coerce_src""",
    ("coerce_src",),
)
def audit_clean_coerce_src(spark, sf_dir):
    """Gaps are filled before types are cast, so x is filled with its commonest text."""
    return audit_table(view(spark, sf_dir, "coerce_src")).clean_df


# Texts that are cast because enough of them are numbers; no column here holds booleans or times as text.
_CAST = "SELECT count(*) FROM kept WHERE family = 'string' AND non_null > 0 AND numbers / non_null >= 0.95"
_GRADED = """CASE WHEN critical > 0 THEN 'CRITICAL' WHEN score >= 95 THEN 'A+ (Excellent)'
    WHEN score >= 90 THEN 'A (Very Good)' WHEN score >= 80 THEN 'B (Good)'
    WHEN score >= 70 THEN 'C (Fair)' WHEN score >= 60 THEN 'D (Poor)' ELSE 'F (Critical)' END AS grade,
  CASE WHEN critical > 0 THEN 'ACTION REQUIRED' WHEN score >= 90 THEN 'HEALTHY'
    WHEN score >= 80 THEN 'REVIEW' ELSE 'NEEDS ATTENTION' END AS status"""
_LABELLED = """CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good'
  WHEN score >= 50 THEN 'Moderate' ELSE 'Poor' END AS label"""


def _scored(source, columns) -> str:
    return (
        f"WITH facts AS ({facts_sql(source, columns)}), kept AS ({_KEPT}), "
        f"penalties AS ({_score_sql(source)}), scored AS ({_SCORED})"
    )


def _size_sql(source, rows_after) -> str:
    return f"""(SELECT count(*) FROM {source}) AS rows_before, {rows_after} AS rows_after,
  (SELECT count(*) FROM {source}) - {rows_after} AS rows_lost, (SELECT count(*) FROM facts) AS columns_before,
  (SELECT count(*) FROM kept) AS columns_after,
  (SELECT count(*) FROM facts) - (SELECT count(*) FROM kept) AS columns_lost"""


def _summary_query(name, source, columns, rows_after):
    @query(
        name,
        f"""{_scored(source, columns)} SELECT {_size_sql(source, rows_after)}, ({_CAST}) AS columns_cast, score,
  {_LABELLED} FROM scored""",
        (source,),
    )
    def run(spark, sf_dir):
        return audit_table(view(spark, sf_dir, source)).summary_df()


# Rows go only where a time is absent.
_summary_query("audit_summary", "lineitem_dirty", DIRTY, "(SELECT count(l_shipdate) FROM lineitem_dirty)")
_summary_query("audit_summary_event_log", "event_log", EVENTS, "(SELECT count(seen_at) FROM event_log)")


@query(
    "audit_overview",
    f"""WITH facts AS ({facts_sql("event_log", EVENTS)}), kept AS ({_KEPT}),
size AS (SELECT {_size_sql("event_log", "(SELECT count(seen_at) FROM event_log)")})
SELECT item, n::VARCHAR AS value FROM (UNPIVOT size ON COLUMNS(*) INTO NAME item VALUE n)""",
    ("event_log",),
)
def audit_overview(spark, sf_dir):
    """The numbers of the report's first section."""
    lines = audit_table(view(spark, sf_dir, "event_log")).report_df()
    return lines.filter("section = 'size' AND item NOT LIKE 'names%'").select("item", "value")


@query(
    "audit_column_profiles",
    f"""WITH facts AS ({facts_sql("event_log", EVENTS)})
SELECT "column", dtype, null_count, round(null_count / total * 100, 2) AS null_pct,
  uniq AS "unique", median, lo AS min, hi AS max FROM facts""",
    ("event_log",),
)
def audit_column_profiles(spark, sf_dir):
    sections = audit_table(view(spark, sf_dir, "event_log")).report["columns"]
    names = ("dtype", "null_count", "null_pct", "unique", "median", "min", "max")
    return spark.createDataFrame(
        [(column, *(s.get(n) for n in names)) for column, s in sections.items()],
        "column STRING, dtype STRING, null_count BIGINT, null_pct DOUBLE, unique BIGINT, "
        "median DOUBLE, min DOUBLE, max DOUBLE",
    )


@query(
    "audit_cleaning_summary",
    f"""WITH facts AS ({facts_sql("event_log", EVENTS)}), kept AS ({_KEPT})
SELECT CASE family WHEN 'datetime' THEN 'drop_rows' ELSE 'filled' END AS kind, count(*) AS columns
FROM kept WHERE null_count > 0 GROUP BY 1""",
    ("event_log",),
)
def audit_cleaning_summary(spark, sf_dir):
    done = cleaning.clean(view(spark, sf_dir, "event_log"))
    return report.actions_by_kind(done.actions_df(spark))


def _score_section_query(name, source, columns, load):
    @query(
        name,
        f"""{_scored(source, columns)}, graded AS (
  SELECT score, (SELECT count(*) FROM facts WHERE round(null_count / total * 100, 2) > 30) AS critical FROM scored)
SELECT score, {_LABELLED}, {_GRADED} FROM graded""",
        (source,) if load is view else (),
    )
    def run(spark, sf_dir):
        section = audit_table(load(spark, sf_dir, source)).report["score"]
        names = ("score", "label", "grade", "status")
        return spark.createDataFrame(
            [tuple(section[n] for n in names)], "score DOUBLE, label STRING, grade STRING, status STRING"
        )


# A column that is all NULL makes the report critical, whatever the score; customers have no such flaw.
_score_section_query("audit_score_section", "event_log", EVENTS, view)
_score_section_query("audit_score_section_customer", "customer", CUSTOMER, table)


@query(
    "audit_skip_clean",
    "SELECT event_id, amount, kind, is_big, seen_at, code, nothing FROM event_log",
    ("event_log",),
)
def audit_skip_clean(spark, sf_dir):
    """Cleaning skipped: gaps and sparse columns stay, only types may change."""
    return audit_table(view(spark, sf_dir, "event_log"), {"skip_clean": True}).clean_df


def _orders_audit_sql():
    return "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query("audit_clean_orders", _orders_audit_sql())
def audit_clean_orders(spark, sf_dir):
    """A table without flaws comes back as it is."""
    return audit_table(table(spark, sf_dir, "orders")).clean_df


