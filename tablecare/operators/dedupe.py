"""Duplicate removal: whole-row copies, and one row per email address.

Order matters here: "first" is the smallest row id, which the caller's table
must carry as a column fixed before any shuffle (see ``sources.staging``). The
row id itself is bookkeeping: it is no part of a row's content.

Hot keys: the exact step combines copies in the map tasks. The per-email step
is a ranking of which only the first row is kept, so Spark keeps one row per
address in every map task (WindowGroupLimit) before it shuffles. A third of the
table sharing one address then arrives as one row per map task. Blank addresses
never meet, so they spread over all partitions.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecare.config import DedupConfig, settings
from tablecare.functions.columns import col, groupable, nan_as_null
from tablecare.functions.emails import email_key
from tablecare.functions.text import is_blank
from tablecare.operators.semantic import SemanticProfile
from tablecare.operators.validate import email_columns
from tablecare.sources.staging import stage


def content(df: DataFrame, row_id: str | None) -> list[str]:
    return [n for n in df.columns if n != row_id]


def completeness(df: DataFrame, row_id: str | None = None) -> Column:
    """How many content columns of the row are filled (neither NULL nor blank)."""
    filled = [
        F.when(is_blank(col(f.name), f.dataType), 0).otherwise(1)
        for f in df.schema.fields
        if f.name != row_id
    ]
    return reduce(add, filled, F.lit(0))


def whole_row(df: DataFrame, row_id: str | None) -> list[Column]:
    return [groupable(col(f.name), f.dataType) for f in df.schema.fields if f.name != row_id]


def drop_exact_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Keep one row of every set of equal rows: the one with the smallest row id."""
    df = nan_as_null(df)
    if row_id is None:
        return df.dropDuplicates()
    names = content(df, row_id)
    if not any(f.dataType.typeName() == "map" for f in df.schema.fields):
        kept = df.groupBy(*[col(n) for n in names]).agg(F.min(col(row_id)).alias(row_id))
        return kept.select(*[col(n) for n in df.columns])
    return _first_per(df, whole_row(df, row_id), [col(row_id)])


def dedupe_by_email(df: DataFrame, email: str, row_id: str) -> DataFrame:
    """Keep the fullest row of every address, the earliest of equally full ones. Rows without
    an address all stay."""
    return _best_per_email(nan_as_null(df), email, row_id, [col(row_id)])


def _best_per_email(
    df: DataFrame, email: str, row_id: str, blank_rows_by: list[Column]
) -> DataFrame:
    """One row per address, and one per ``blank_rows_by`` among rows without an address."""
    order = [completeness(df, row_id).desc(), col(row_id)]
    keyed = df.withColumn("__key", email_key(col(email)))
    key = F.col("__key")
    own = F.when(key.isNull(), F.struct(*blank_rows_by))
    return _first_per(keyed, [key, own], order).drop("__key")


def _first_per(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def deduplicate_leads(
    df: DataFrame, profile: SemanticProfile, config=None, row_id: str = "row_id"
) -> DataFrame:
    """Drop whole-row copies, then keep one row per address, email column by email column.

    Equal rows share their address and their completeness, so ranking by address
    already leaves one of them, the earliest. Only rows without an address need
    the whole row as their key. Both steps therefore share a single shuffle.
    """
    cfg = settings(DedupConfig, config)
    df = nan_as_null(df)
    emails = email_columns(df, profile) if cfg.remove_email_duplicates else []
    if not emails:
        return drop_exact_duplicates(df, row_id) if cfg.remove_exact_duplicates else df
    for i, email in enumerate(emails):
        if i == 0 and cfg.remove_exact_duplicates:
            df = _best_per_email(df, email, row_id, whole_row(df, row_id))
        else:
            df = dedupe_by_email(df, email, row_id)
    return df


def count_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row: all rows, rows that repeat an earlier one, and rows left without them."""
    df = nan_as_null(df)
    groups = df.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(whole_row(df, row_id))])
    return (
        groups.agg(F.count("*").alias("copies"))
        .groupBy()
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
            F.count("*").alias("distinct_rows"),
        )
    )


def dedup_report(before: DataFrame, after: DataFrame, config=None, row_id: str = "row_id"):
    """One row of counts: input, output, and what each step removed."""
    cfg = settings(DedupConfig, config)
    none = F.lit(None).cast("bigint")
    found = count_duplicates(before, row_id).select("total_rows", "duplicate_rows", none.alias("kept"))
    kept = after.groupBy().agg(F.count("*").alias("kept")).select(none, none, "kept")
    both = found.union(kept).groupBy().agg(
        *[F.max(n).alias(n) for n in ("total_rows", "duplicate_rows", "kept")]
    )
    exact = F.col("duplicate_rows") if cfg.remove_exact_duplicates else F.lit(0).cast("bigint")
    return both.select(
        F.col("total_rows").alias("input_rows"),
        F.col("kept").alias("output_rows"),
        exact.alias("exact_duplicates_removed"),
        (F.col("total_rows") - exact - F.col("kept")).alias("email_duplicates_removed"),
        F.col("kept").alias("rows_retained"),
    )


#: Digests of repeated rows that are broadcast, 16 bytes each; with more, whole rows are shuffled after all.
REPEATED = 500_000


def _digested(df: DataFrame, row_id: str | None) -> DataFrame:
    """``df`` with two hashes of its whole rows. Rows with other hashes differ; those with equal ones may."""
    whole = whole_row(df, row_id)
    return df.withColumns({"__d1": F.xxhash64(*whole), "__d2": F.xxhash64(F.lit(1), *reversed(whole))})


def _repeated(digested: DataFrame) -> DataFrame | None:
    """The digests that several rows have, staged; None if there are too many of them to be broadcast."""
    counted = digested.groupBy("__d1", "__d2").agg(F.count("*").alias("n")).where("n > 1")
    found = stage(counted, "repeated")
    return found if found.count() <= REPEATED else None


def drop_exact_duplicates_by_digest(df: DataFrame, row_id: str) -> DataFrame:
    """``drop_exact_duplicates`` for wide rows of which few are repeated.

    The table is read twice, but what is shuffled of it are 16 bytes a row, and whole rows only
    where those are alike. These are compared by value, so no row goes for a hash alone.
    """
    df = nan_as_null(df)
    digested = _digested(df, row_id)
    repeated = _repeated(digested.select("__d1", "__d2"))
    if repeated is None:
        return drop_exact_duplicates(df, row_id)
    known = F.broadcast(repeated.select("__d1", "__d2"))
    alone = digested.join(known, ["__d1", "__d2"], "left_anti").select(*map(col, df.columns))
    alike = digested.join(known, ["__d1", "__d2"], "left_semi").select(*map(col, df.columns))
    return alone.unionByName(drop_exact_duplicates(alike, row_id).select(*map(col, df.columns)))


def count_duplicates_by_digest(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """``count_duplicates`` in the way of ``drop_exact_duplicates_by_digest``."""
    df = nan_as_null(df)
    digested = _digested(df, row_id)
    repeated = _repeated(digested.select("__d1", "__d2"))
    if repeated is None:
        return count_duplicates(df, row_id)
    known = F.broadcast(repeated.select("__d1", "__d2"))
    alike = digested.join(known, ["__d1", "__d2"], "left_semi").drop("__d1", "__d2")
    total = df.groupBy().agg(F.count("*").alias("total_rows"))
    return total.crossJoin(count_duplicates(alike, row_id).select("duplicate_rows")).select(
        "total_rows", "duplicate_rows", (F.col("total_rows") - F.col("duplicate_rows")).alias("distinct_rows")
    )
