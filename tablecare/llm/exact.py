"""Exact deduplication that takes heavy hitters out before it shuffles.

Texts are equal when they are identical after each run of white space has become one space.
Every text is read once, for its SHA-256; the digests are staged. Misra-Gries summaries (Spark's
mergeable ``approx_top_k`` sketches, one for each branch of tasks) name every digest that more
than one row in ``HEAVY`` has; an exact count verifies them. The winners of these, at most ``HEAVY`` rows, are
broadcast, so rows of a large group are decided where they are read. Only the others are
shuffled, and no group among those is larger than one row in ``HEAVY``.

Defined cases: null text is the empty text; a null doc_id comes after every other; of rows with
equal text and equal doc_id exactly one stays; an empty table gives an empty result; other
columns never matter and, in ``keep_first``, pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablecare.llm.common import documents, free_name, staged, text_of

#: A digest is heavy if more than one row in so many has it: also the most rows ever broadcast.
HEAVY = 8192
#: Counters of a sketch; the sketch holds at most three quarters of them after a purge.
COUNTERS = 32768
#: Sketches are merged in so many groups of tasks; so ``BRANCHES * HEAVY`` hashes at most are counted exactly.
BRANCHES = 16


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def _winners(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, same_id) of heavy digests: at most ``HEAVY`` rows."""
    branches = (
        digests.select(
            F.xxhash64("digest").alias("item"),
            F.pmod(F.spark_partition_id(), F.lit(BRANCHES)).alias("branch"),
        )
        .groupBy("branch")
        .agg(F.expr(f"approx_top_k(item, {HEAVY}, {COUNTERS})").alias("top"), F.count("*").alias("n"))
    )
    # What is heavy among all rows is heavy in some branch.
    likely = (
        branches.select("n", F.explode("top").alias("top"))
        .where((F.col("top.count") > 1) & (F.col("top.count") * HEAVY > F.col("n")))
        .select(F.col("top.item").alias("item"))
        .distinct()
    )
    total = digests.agg(F.count("*").alias("total"))
    counted = (
        digests.withColumn("item", F.xxhash64("digest"))
        .join(F.broadcast(likely), "item")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .join(F.broadcast(total), F.col("group_size") * HEAVY > F.col("total"))
        .select("digest", "keep_id", "group_size")
    )
    same = (
        digests.join(F.broadcast(counted), "digest")
        .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "keep_id", "group_size")
        .agg(F.count("*").alias("same_id"))
    )
    return staged(same, "heavy")


def label_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    digests = staged(docs.select("doc_id", text_digest(text_of()).alias("digest")), "digests")
    winners = _winners(digests)
    columns = ["doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")]
    others = (
        digests.join(F.broadcast(winners), "digest")
        .where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .withColumn("kept", F.lit(False))
    )
    # Rows with the winner's own doc_id are told apart by number alone.
    first = winners.select(
        "*", F.col("keep_id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.col("same_id"))).alias("i")
    ).withColumn("kept", F.col("i") == 1)
    group = Window.partitionBy("digest")
    cold = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumns(
            {
                "keep_id": F.min("doc_id").over(group),
                "group_size": F.count("*").over(group),
                "kept": F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())) == 1,
            }
        )
    )
    return others.select(columns).unionByName(first.select(columns)).unionByName(cold.select(columns))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Losers of heavy groups are dropped where they are read; what is left is shuffled once, by
    digest, and each task sends at most one row of a digest.
    """
    digest, keep = free_name(docs, "digest"), free_name(docs, "keep_id")
    digests = staged(docs.select("doc_id", text_digest(text_of()).alias("digest")), "digests")
    winners = _winners(digests).select(F.col("digest").alias(digest), F.struct("keep_id").alias(keep))
    rank = free_name(docs, "rank")
    first = Window.partitionBy(digest).orderBy(F.col("doc_id").asc_nulls_last())
    return (
        docs.withColumn(digest, text_digest(text_of()))
        .join(F.broadcast(winners), digest, "left")
        .where(F.col(keep).isNull() | F.col("doc_id").eqNullSafe(F.col(keep)["keep_id"]))
        .withColumn(rank, F.row_number().over(first))
        .where(F.col(rank) == 1)
        .select([F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_copies(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
