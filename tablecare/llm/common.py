"""What the operators on training text share: reading, shared folders, names that clash with nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablecare.sources.staging import new_path

#: Rows of an Arrow batch of texts.
ARROW_ROWS = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """At most ``ARROW_ROWS`` whole texts in the batches that Python workers get, from now on in this session.

    Spark's default of 10,000 is meant for rows of a few numbers; both the executor and its workers
    hold such a batch of texts more than once.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` has not got, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back: later jobs, and tasks
    that run again after an executor is lost, find the same rows."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(key: str, modulus: int) -> Column:
    """crc32 of a key's decimal text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def least_hashed(rows: DataFrame, group: str, key: str, most: Callable[[int], int]) -> DataFrame:
    """(group, key): of each group the keys with the smallest hashes, ``most(number of groups)`` at most.

    Rows are counted by group, which tells below what hash enough keys should lie. Only those
    below it are shuffled, each once, so neither the task of a group nor the rows sent grow with
    the table; where too few lie there (a key that most rows have), the bound is raised.
    """
    spark = rows.sparkSession
    count = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    wanted = max(1, most(len(count)))
    share = {g: min(1.0, 4 * wanted / n) for g, n in count.items()}
    kind = StructType([rows.schema[group], StructField("bound", LongType())])
    hashed = rows.select(group, key, F.xxhash64(key).alias("hash"))
    while True:
        bounds = spark.createDataFrame([(g, min(int(s * 2**64) - 2**63, 2**63 - 1)) for g, s in share.items()], kind)
        below = hashed.join(F.broadcast(bounds), group).where("hash <= bound").drop("bound").distinct()
        below = staged(below, "least")
        have = {r[0]: r[1] for r in below.groupBy(group).count().collect()}
        short = [g for g, s in share.items() if s < 1 and have.get(g, 0) < wanted]
        if not short:
            break
        share.update((g, min(1.0, 16 * share[g])) for g in short)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("hash", key))
    return below.withColumn("rank", rank).where(F.col("rank") <= wanted).select(group, key)


def one_text(rows: DataFrame, *key: str) -> DataFrame:
    """(key, text): of the rows with the same key one text, that with the smallest hash."""
    return (
        rows.groupBy(*key)
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
        .select(*key, F.col("least.text").alias("text"))
    )
