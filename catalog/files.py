"""Queries on sources and sinks: derived tables are written as files and read back.

The files go to the session's shared checkpoint folder, one new folder per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.leads import _CLEAN_LEADS
from catalog.registry import query
from catalog.views import table, view
from tablecare import fixed_values as fv
from tablecare.plans.audit import audit_csv
from tablecare.plans.leads import process_leads
from tablecare.sources import csv as csv_source
from tablecare.sources import sinks
from tablecare.sources.staging import new_path, with_row_id

LINE_KEY = ("l_orderkey", "l_linenumber")
_NA = ", ".join(f"'{t}'" for t in fv.NA_TOKENS)
#: Bytes of text in a CSV file that one task writes, about; Spark cuts it into several pieces.
FILE_TEXT = 1 << 28



@query(
    "read_leads",
    f"SELECT row_id::VARCHAR AS row_id, name, email, nullif(phone, '') AS phone FROM leads",
    ("leads",),
)
def read_leads(spark, sf_dir):
    """Text stays text; empty cells come back as missing."""
    path = new_path(spark, "leads-csv")
    sinks.write_table(view(spark, sf_dir, "leads"), path)
    return csv_source.read_leads(spark, path).df


@query(
    "read_leads_typed",
    "SELECT row_id, name, email, nullif(phone, '') AS phone FROM leads",
    ("leads",),
)
def read_leads_typed(spark, sf_dir):
    path = new_path(spark, "leads-csv")
    sinks.write_table(view(spark, sf_dir, "leads"), path)
    return csv_source.read_leads(spark, path, infer_schema=True).df



@query(
    "csv_na_tokens",
    """SELECT p_partkey::VARCHAR AS p_partkey, NULL::VARCHAR AS word, p_name FROM part""",
)
def csv_na_tokens(spark, sf_dir):
    """Every spelling of "missing" turns into NULL."""
    tokens = F.array(*[F.lit(t) for t in fv.NA_TOKENS])
    path = new_path(spark, "na-csv")
    word = F.get(tokens, (F.col("p_partkey") % len(fv.NA_TOKENS)).cast("int")).alias("word")
    sinks.write_table(table(spark, sf_dir, "part").select("p_partkey", word, "p_name"), path)
    return csv_source.read_leads(spark, path).df


@query(
    "csv_typed_columns",
    """SELECT p_partkey, p_retailprice, p_size % 2 = 0 AS even, p_size::BIGINT AS p_size, p_name,
  CASE WHEN p_size > 25 THEN p_size::DOUBLE / 2 END AS half FROM part""",
)
def csv_typed_columns(spark, sf_dir):
    """Numbers and booleans are recognised, with gaps; semicolons are found out."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_retailprice", (F.col("p_size") % 2 == 0).alias("even"), "p_size", "p_name",
        F.when(F.col("p_size") > 25, F.col("p_size") / 2).alias("half"),
    )
    path = new_path(spark, "typed-csv")
    part.write.options(header=True, sep=";").csv(path)
    return csv_source.read_audit_csv(spark, path).df


def _ragged(spark, sf_dir):
    """Lines of CSV text: a header per file, then short, full, over-long and quoted rows."""
    path = new_path(spark, "ragged-csv")
    key = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(key, F.lit(",long,"), key, F.lit(",extra")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(key, F.lit(",long,x,")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", key)
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(key, F.lit(',"a,b ""c""",'), key))
        .otherwise(F.concat(key, F.lit(",plain,"), key))
    )
    return _written(table(spark, sf_dir, "orders").select(line.alias("line"), "o_orderkey"), path, " id ,what, value")


def _written(lines: DataFrame, path: str, header: str) -> str:
    """Text files with a header each: Spark's CSV writer writes the lines as single cells."""
    lines.select(F.col("line").alias(header)).write.options(
        header=True, sep="\x01", quote="\x02", escape="\x02", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


@query(
    "csv_ragged_rows",
    """SELECT o_orderkey::VARCHAR AS id,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN NULL WHEN '5-LOW' THEN 'a,b "c"' ELSE 'plain' END AS what,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN NULL ELSE o_orderkey::VARCHAR END AS value
FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""",
)
def csv_ragged_rows(spark, sf_dir):
    """Short rows are padded, over-long ones set apart, header names stripped."""
    return csv_source.read_csv_text(spark, _ragged(spark, sf_dir)).df


@query(
    "csv_malformed_rows",
    """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN o_orderkey || ',long,' || o_orderkey || ',extra'
  ELSE o_orderkey || ',long,x,' END AS text
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def csv_malformed_rows(spark, sf_dir):
    loaded = csv_source.read_csv_text(spark, _ragged(spark, sf_dir))
    return loaded.malformed.withColumnRenamed(csv_source.CORRUPT, "text")


@query(
    "csv_unnamed_columns",
    "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier",
)
def csv_unnamed_columns(spark, sf_dir):
    """A column without a header is dropped."""
    path = new_path(spark, "unnamed-csv")
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias(" "), "s_name"
    )
    sinks.write_table(supplier, path)
    return csv_source.read_csv_text(spark, path).df


@query(
    "csv_load_metadata",
    """SELECT 'UTF-8' AS encoding, '|' AS delimiter, count(*) AS original_rows, 4 AS original_cols,
  0::BIGINT AS malformed_rows FROM supplier""",
)
def csv_load_metadata(spark, sf_dir):
    path = new_path(spark, "supplier-csv")
    table(spark, sf_dir, "supplier").write.options(header=True, sep="|").csv(path)
    return csv_source.read_audit_csv(spark, path).counts()


@query(
    "csv_delimiters",
    """SELECT status, CASE status WHEN 'F' THEN ';' WHEN 'O' THEN chr(9) ELSE '|' END AS delimiter,
  count(*) AS lines, count(*) AS agreeing_lines
FROM (SELECT o_orderstatus AS status FROM orders) GROUP BY status""",
)
def csv_delimiters(spark, sf_dir):
    """Many files for each of three delimiters; commas inside quotes do not count."""
    path = new_path(spark, "delimiters")
    sep = F.when(F.col("o_orderstatus") == "F", ";").when(F.col("o_orderstatus") == "O", "\t")
    cells = F.array(
        *[F.col(n).cast("string") for n in ("o_orderkey", "o_custkey", "o_orderpriority")],
        F.lit('"one, two"'),
    )
    line = F.array_join(cells, "@")
    line = F.replace(line, F.lit("@"), sep.otherwise("|"))
    orders = table(spark, sf_dir, "orders").select(line.alias("value"), "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").text(path)
    found = csv_source.infer_delimiters(spark, f"{path}/*")
    status = F.regexp_extract("file", "o_orderstatus=([A-Z])", 1).alias("status")
    return found.groupBy(status, "delimiter").agg(
        F.sum("lines").alias("lines"), F.sum("agreeing_lines").alias("agreeing_lines")
    )


@query(
    "csv_quoted_breaks",
    """SELECT c_custkey::VARCHAR AS c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || '"' || c_mktsegment || '", ' || chr(10) ELSE c_name END AS note
FROM customer""",
)
def csv_quoted_breaks(spark, sf_dir):
    """Cells with line breaks, quotes and commas come back whole, without being asked for."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    note = F.when(F.col("c_custkey") % 3 == 0, F.concat(name, F.lit('\n"'), segment, F.lit('", \n'))).otherwise(name)
    path = new_path(spark, "breaks-csv")
    sinks.write_table(table(spark, sf_dir, "customer").select("c_custkey", note.alias("note")), path)
    return csv_source.read_leads(spark, path).df


@query(
    "csv_quoted_breaks_one_file",
    "SELECT doc_id::VARCHAR AS doc_id, text, lang, n_chars::VARCHAR AS n_chars FROM documents",
)
def csv_quoted_breaks_one_file(spark, sf_dir):
    """One file with line breaks in many cells, read in as many pieces as Spark cuts it into.

    A file is written by one task, so tables of more than ``FILE_TEXT`` bytes of text make several.
    """
    path = new_path(spark, "one-file-csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sinks.write_table(docs.coalesce(max(1, -(-size // FILE_TEXT))), path)
    return csv_source.read_csv_text(spark, path).df


@query(
    "csv_mixed_headers",
    """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer
UNION ALL SELECT s_suppkey::VARCHAR, s_name, NULL FROM supplier""",
)
def csv_mixed_headers(spark, sf_dir):
    """Files of a folder that have other columns, in another order."""
    path = new_path(spark, "mixed-csv")
    sinks.write_table(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name"), f"{path}/one")
    supplier = table(spark, sf_dir, "supplier")
    sinks.write_table(
        supplier.select(F.col("s_name").alias("c_name"), F.col("s_suppkey").alias("c_custkey")), f"{path}/two"
    )
    return csv_source.read_leads(spark, [f"{path}/one", f"{path}/two"]).df.select("c_custkey", "c_name", "c_mktsegment")


@query(
    "lead_malformed_counts",
    """SELECT count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS original_rows,
  count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS malformed_rows FROM orders""",
)
def lead_malformed_counts(spark, sf_dir):
    """Rows with more cells than the header are counted, not lost."""
    return csv_source.read_leads(spark, _ragged(spark, sf_dir)).counts().select("original_rows", "malformed_rows")


@query(
    "csv_windows_1252",
    """SELECT s_suppkey, '“' || s_name || '” – 5 €' AS "näme" FROM supplier""",
)
def csv_windows_1252(spark, sf_dir):
    """Typographic quotes, dashes and the euro sign, in the header too."""
    text = F.concat(F.lit("\x93"), F.col("s_name"), F.lit("\x94 \x96 5 \x80"))
    path = new_path(spark, "cp1252-csv")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("näme"))
    rows.write.options(header=True, encoding="ISO-8859-1").csv(path)
    return csv_source.read_audit_csv(spark, path, sep=",", encoding="windows-1252").df


@query(
    "row_ids",
    """SELECT count(*) AS n_rows, count(*) AS n_ids, 0::BIGINT AS n_out_of_order FROM lineitem""",
)
def row_ids(spark, sf_dir):
    """Row ids of files that are numbered by their names, of growing sizes: one per row, in order."""
    path = new_path(spark, "ordered")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.xxhash64(*LINE_KEY).alias("key"))
    share = F.when(F.pmod("key", F.lit(100)) < 2, "a").when(F.pmod("key", F.lit(100)) < 20, "b").otherwise("c")
    lines.withColumn("part", share).write.partitionBy("part").parquet(path)
    files = [f"{path}/part={p}" for p in "cab"]
    df = with_row_id(spark.read.parquet(*files).withColumn("part", F.regexp_extract(F.input_file_name(), "part=(.)", 1)), "row_id")
    spans = df.groupBy("part").agg(F.min("row_id").alias("low"), F.max("row_id").alias("high")).alias("x")
    late = spans.join(spans.alias("y"), F.expr("x.part < y.part AND x.high >= y.low")).agg(F.count("*").alias("n_out_of_order"))
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_ids")).crossJoin(late)


@query(
    "lead_dedupe_two_files",
    """SELECT c_custkey::VARCHAR AS id, 'a' AS file FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'b' FROM customer WHERE c_custkey % 50 <> 0""",
)
def lead_dedupe_two_files(spark, sf_dir):
    """Of rows with the same address the one in the first file stays, though that file is small."""
    path = new_path(spark, "two-files")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("u"), "c_custkey", F.lit("@x.org")).alias("email")
    )
    small = rows.where(F.col("id") % 50 == 0).withColumn("file", F.lit("a"))
    sinks.write_table(small, f"{path}/a")
    sinks.write_table(rows.withColumn("file", F.lit("b")), f"{path}/b")
    steps = {"run_formatting": False}
    return process_leads(csv_source.read_leads(spark, [f"{path}/b", f"{path}/a"]), steps).clean.select("id", "file")


@query(
    "lead_outputs_clean",
    f"""{_CLEAN_LEADS} SELECT row_id::VARCHAR AS row_id, name, first_name,
  nullif(last_name, '') AS last_name, email, nullif(phone, '') AS phone,
  is_role_email::VARCHAR AS is_role_email FROM kept""",
    ("leads",),
)
def lead_outputs_clean(spark, sf_dir):
    """The whole lead plan written to disk, and its clean rows read back."""
    path = new_path(spark, "lead-outputs")
    sinks.write_lead_outputs(process_leads(view(spark, sf_dir, "leads"), row_id="row_id"), path)
    return csv_source.read_leads(spark, f"{path}/crm_ready").df


@query(
    "lead_outputs_published",
    f"""{_CLEAN_LEADS} SELECT row_id::VARCHAR AS row_id, name, first_name,
  nullif(last_name, '') AS last_name, email, nullif(phone, '') AS phone,
  is_role_email::VARCHAR AS is_role_email FROM kept""",
    ("leads",),
)
def lead_outputs_published(spark, sf_dir):
    """Two versions of the outputs; the clean rows of the second, as the manifest says."""
    path = new_path(spark, "lead-versions")
    leads = view(spark, sf_dir, "leads")
    sinks.publish_lead_outputs(process_leads(leads.where("row_id % 2 = 0"), row_id="row_id"), path)
    sinks.publish_lead_outputs(process_leads(leads, row_id="row_id"), path)
    return csv_source.read_leads(spark, sinks.published_outputs(spark, path)["crm_ready"]).df


@query(
    "lead_outputs_rejected",
    f"""{_CLEAN_LEADS} SELECT row_id::VARCHAR AS row_id, name, first_name,
  nullif(last_name, '') AS last_name, nullif(email, '') AS email, nullif(phone, '') AS phone,
  why AS rejection_reason FROM checked WHERE why IS NOT NULL""",
    ("leads",),
)
def lead_outputs_rejected(spark, sf_dir):
    path = new_path(spark, "lead-outputs")
    sinks.write_lead_outputs(process_leads(view(spark, sf_dir, "leads"), row_id="row_id"), path)
    return csv_source.read_leads(spark, f"{path}/rejected").df


@query(
    "lead_outputs_report",
    f"""{_CLEAN_LEADS} SELECT (SELECT count(*) FROM leads) AS input_rows,
  (SELECT count(*) FROM kept) AS output_rows,
  (SELECT count(*) FROM checked WHERE why IS NOT NULL) AS rejected_rows,
  (SELECT count(*) FROM valid WHERE is_role_email) AS role_based_email_count""",
    ("leads",),
)
def lead_outputs_report(spark, sf_dir):
    path = new_path(spark, "lead-outputs")
    sinks.write_lead_outputs(
        process_leads(view(spark, sf_dir, "leads"), row_id="row_id"), path, "parquet"
    )
    report = spark.read.json(f"{path}/report")
    return report.select(
        "input_rows", "output_rows", "rejected_rows", "validation.role_based_email_count"
    )


@query(
    "audit_csv_saved",
    """SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
)
def audit_csv_saved(spark, sf_dir):
    """A table written as CSV, audited from there, saved clean and read once more."""
    path, saved = new_path(spark, "customer-csv"), new_path(spark, "customer-clean")
    sinks.write_table(table(spark, sf_dir, "customer"), path)
    audit_csv(spark, path, save_clean=saved)
    return csv_source.read_audit_csv(spark, saved).df
