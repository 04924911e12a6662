"""Dirty tables derived from the given ones, since those hold no blanks or copies.

The same SQL text runs in Spark and in the checking engine. Every view covers
its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Contacts of customers: names in every case, blank, malformed, shared and role addresses.
LEADS = """
SELECT c_custkey AS row_id,
  CASE c_custkey % 7 WHEN 0 THEN '  JOHN  SMITH ' WHEN 1 THEN 'mary-jane watson'
    WHEN 2 THEN 'conor o''brien' WHEN 3 THEN 'Ravi Prakash Singh'
    WHEN 4 THEN 'ANKIT SHARMA' WHEN 5 THEN 'Cher' ELSE NULL END AS name,
  CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN 'bad_email'
    WHEN 3 THEN concat('user', CAST(c_custkey % 400 AS VARCHAR(20)), '@localhost')
    WHEN 4 THEN concat('Info@Corp', CAST(c_custkey % 50 AS VARCHAR(20)), '.com')
    ELSE concat(' User', CAST(c_custkey % 400 AS VARCHAR(20)), '@Example.com') END AS email,
  CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN NULL
    ELSE concat('+1 555 ', CAST(1000000 + c_custkey AS VARCHAR(20))) END AS phone
FROM customer
"""

# Sign-ups, one per order: a third of them under one address, whole-row copies among them,
# two address columns, and columns of every other kind of meaning.
SIGNUPS = """
SELECT o_orderkey AS row_id,
  CASE o_custkey % 6 WHEN 0 THEN concat(chr(160), 'ANNE-MARIE   d''arcy', chr(9))
    WHEN 1 THEN 'li wu' WHEN 2 THEN 'JUAN CARLOS DE BORBON' WHEN 3 THEN 'x''y''z o''neil-d''or'
    WHEN 4 THEN 'Grace Hopper' ELSE NULL END AS full_name,
  CASE WHEN o_custkey % 3 = 0 THEN ' Sales@Hot.Example.COM'
    WHEN o_custkey % 31 = 1 THEN NULL WHEN o_custkey % 31 = 2 THEN 'two@at@signs.com'
    WHEN o_custkey % 31 = 3 THEN 'dot@.example' WHEN o_custkey % 31 = 4 THEN 'gap in@it.org'
    ELSE concat('u', CAST(o_custkey AS VARCHAR(20)), '@Mail.org') END AS email,
  CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_custkey % 17 = 0 THEN 'no address'
    ELSE concat('Help@h', CAST(o_custkey % 40 AS VARCHAR(20)), '.net') END AS mail,
  CASE o_custkey % 4 WHEN 0 THEN concat('(555) ', CAST(1000000 + o_custkey AS VARCHAR(20)))
    WHEN 1 THEN NULL ELSE concat('+44 20-', CAST(1000000 + o_custkey AS VARCHAR(20))) END AS mobile,
  CASE o_custkey % 5 WHEN 0 THEN 'Acme Widgets Inc' WHEN 1 THEN 'Foo GmbH' WHEN 2 THEN 'Bar Pvt. Ltd.'
    WHEN 3 THEN 'Plain Name' ELSE 'Baz Co.' END AS org,
  CASE o_custkey % 8 WHEN 0 THEN concat('https://www.linkedin.com/in/u', CAST(o_custkey AS VARCHAR(20)))
    WHEN 1 THEN 'ftp://not.web' ELSE concat('WWW.site', CAST(o_custkey % 90 AS VARCHAR(20)), '.org')
    END AS site,
  CASE o_custkey % 3 WHEN 0 THEN 'smith' WHEN 1 THEN 'o''HARA' ELSE 'van dyke' END AS nickname,
  o_orderpriority AS priority, o_totalprice AS spent
FROM orders
"""

# Columns with two and with three values among all customers.
FEW_ADDRESSES = """
SELECT c_custkey AS row_id, c_name AS name,
  CASE WHEN c_custkey <= 2 THEN concat('u', CAST(c_custkey AS VARCHAR(20)), '@x.org') END AS two,
  CASE WHEN c_custkey <= 3 THEN concat('u', CAST(c_custkey AS VARCHAR(20)), '@x.org') END AS three
FROM customer
"""

# Line items with gaps, wild values, a sparse and a constant column; rows of line 7 came twice.
_LINES = """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN l_quantity * 100
    ELSE l_quantity END AS quantity,
  CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE l_returnflag END AS returnflag,
  CASE WHEN l_suppkey % 10 < 7 THEN NULL ELSE l_extendedprice END AS sparse_price,
  'X' AS constant_col, l_shipdate
FROM lineitem
"""
LINEITEM_DIRTY = f"{_LINES} UNION ALL {_LINES} WHERE l_linenumber = 7"

# Events with gaps in a number, a word, a boolean and a time, and numbers kept as text.
EVENT_LOG = """
SELECT event_id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE value END AS amount,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS kind,
  CASE WHEN user_id % 6 = 0 THEN NULL ELSE value > 30 END AS is_big,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS seen_at,
  CASE WHEN event_id % 8 = 0 THEN 'n/a' ELSE CAST(user_id * 3 AS VARCHAR(20)) END AS code,
  CAST(NULL AS VARCHAR(20)) AS nothing
FROM events
"""

# Text columns that hold booleans, numbers and dates.
COERCE_SRC = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'TRUE' ELSE '0' END AS b,
  CASE WHEN o_orderkey % 50 = 0 THEN 'n/a?'
    WHEN o_orderkey % 2 = 0 THEN concat(' ', CAST(o_custkey AS VARCHAR(20)))
    ELSE concat(CAST(o_custkey AS VARCHAR(20)), '.0') END AS n,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('-', CAST(o_custkey AS VARCHAR(20)), '.5') END AS x,
  CASE WHEN o_orderkey % 20 = 0 THEN 'unknown'
    ELSE concat('2024-', lpad(CAST(1 + o_orderkey % 12 AS VARCHAR(2)), 2, '0'), '-',
                lpad(CAST(1 + o_orderkey % 28 AS VARCHAR(2)), 2, '0')) END AS ts,
  concat(CAST(1 + o_orderkey % 28 AS VARCHAR(2)), '/', CAST(1 + o_orderkey % 12 AS VARCHAR(2)),
         '/2023') AS d,
  CASE WHEN o_orderkey % 10 = 0 THEN '17' WHEN o_orderkey % 7 = 0 THEN '1d'
    ELSE o_orderpriority END AS w,
  CAST(NULL AS VARCHAR(20)) AS z
FROM orders
"""

VIEWS = {
    "leads": (LEADS, ("customer",)),
    "signups": (SIGNUPS, ("orders",)),
    "few_addresses": (FEW_ADDRESSES, ("customer",)),
    "lineitem_dirty": (LINEITEM_DIRTY, ("lineitem",)),
    "event_log": (EVENT_LOG, ("events",)),
    "coerce_src": (COERCE_SRC, ("orders",)),
}


# Tables whose rows take much work per byte (text is matched against patterns) and the
# columns that tell their rows apart. Each given file is a single row group, which is one task
# however large, so the queries deal these tables out; tables in many pieces need no such thing.
TEXT_HEAVY = {"orders": "o_orderkey", "customer": "c_custkey", "documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(TEXT_HEAVY[name]) if name in TEXT_HEAVY else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dirty view over the tables of ``sf_dir``."""
    sql, sources = VIEWS[name]
    for source in sources:
        table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(sql)
