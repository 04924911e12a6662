"""Deduplicated leads that are kept up to date, batch after batch.

The result is what ``deduplicate_leads`` leaves of all rows of all batches together, however they
were cut into batches and in whatever order those came, for a row's id says which came first.

There is a level for each address column, and one if there is none. Rows lie in buckets by the
hash of their address, or of the whole row where they have none. A batch's rows are deduplicated
among themselves first; then only the buckets they fall into are read, merged and written anew.

* The first level holds the best row of every address. More rows only ever replace it, so nothing
  else need be known of the rows that lost.
* A row that leaves one level may have kept another from being the best of its address on the
  next. So later levels hold all rows that the level before lets through, marked whether they are
  the best, and get what has changed: rows that came and rows that went.

A merge that fails changes nothing (see ``sources.published``), and a batch that comes again
finds its rows there already. Rows with the same id must be the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablecare.config import DedupConfig, settings
from tablecare.functions.columns import col, nan_as_null
from tablecare.functions.emails import email_key
from tablecare.operators.dedupe import completeness, whole_row
from tablecare.operators.semantic import SemanticProfile
from tablecare.operators.validate import email_columns
from tablecare.sources.published import Published, Version
from tablecare.sources.staging import stage

SCORE, KEPT, BUCKET = "__score", "__kept", "__bucket"
#: Files that a bucket is written in at most, so that a crowded one is more than one task's work.
SPREAD = 8


class Survivors:
    """The survivors stored at ``path``. All batches must have the same columns."""

    def __init__(
        self, spark: SparkSession, path: str, profile: SemanticProfile, config=None, row_id: str = "row_id", buckets: int = 64
    ):
        self.spark, self.profile, self.row_id, self.buckets = spark, profile, row_id, buckets
        self.cfg = settings(DedupConfig, config)
        self.store = Published(spark, path)

    def merge(self, batch: DataFrame, batch_id: int | None = None) -> Version:
        """Take in a batch. One with an id that has been taken in already changes nothing, so this
        can be called from ``foreachBatch``."""
        now = self.store.current()
        if batch_id is not None and batch_id <= now.notes.get("batch", -1):
            return now
        names = now.notes.get("columns", batch.columns)
        if sorted(names) != sorted(batch.columns):
            raise ValueError(f"a batch with columns {batch.columns}, where others had {names}")
        rows = nan_as_null(batch.select(*map(col, names)))
        emails = email_columns(rows, self.profile) if self.cfg.remove_email_duplicates else []
        rows = rows.withColumn(SCORE, completeness(rows, self.row_id))
        folders = dict(now.folders)
        came, went = self._first_level(rows, emails[0] if emails else None, folders)
        for k, email in enumerate(emails[1:], 1):
            came, went = self._next_level(came, went, email, k, folders)
        notes = {"columns": names, "levels": max(1, len(emails))}
        last = now.notes.get("batch") if batch_id is None else batch_id
        return self.store.publish(folders, notes if last is None else notes | {"batch": last})

    def read(self) -> DataFrame:
        """All survivors, with the columns of the batches."""
        now = self.store.current()
        if not now.number:
            raise ValueError(f"nothing has been merged into {self.store.path}")
        level = now.notes["levels"] - 1
        rows = self._stored(now.folders, level, range(self.buckets))
        if rows is None:
            raise ValueError("only empty batches have been merged")
        rows = rows.where(KEPT) if level else rows
        return rows.select(*map(col, now.notes["columns"]))

    def _first_level(self, rows: DataFrame, email: str | None, folders: dict[str, str]):
        keys = self._keys(rows, email)
        own = stage(self._in_buckets(self._best(rows, keys), keys), "batch")
        touched = self._touched(own)
        old = self._stored(folders, 0, touched)
        new = own if old is None else self._in_buckets(self._best(old.unionByName(own.drop(BUCKET)), keys), keys)
        new = self._written(new, 0, touched, folders)
        return self._changes(old, new)

    def _next_level(self, came: DataFrame, went: DataFrame, email: str, level: int, folders: dict[str, str]):
        keys = self._keys(came, email)
        came, went = (stage(self._in_buckets(x, keys), "changes") for x in (came, went))
        touched = self._touched(came.select(BUCKET).unionByName(went.select(BUCKET)))
        old = self._stored(folders, level, touched)
        members = came.drop(BUCKET)
        if old is not None:
            stayed = old.drop(KEPT).join(went.select(col(self.row_id)), self.row_id, "left_anti")
            stayed = stayed.join(came.select(col(self.row_id)), self.row_id, "left_anti")
            members = members.unionByName(stayed)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(SCORE), col(self.row_id)))
        marked = members.withColumn("__rank", rank).withColumn(KEPT, F.col("__rank") == 1).drop("__rank")
        new = self._written(self._in_buckets(marked, keys), level, touched, folders)
        was = None if old is None else old.where(KEPT).drop(KEPT)
        return self._changes(was, new.where(KEPT).drop(KEPT))

    def _keys(self, rows: DataFrame, email: str | None) -> list[Column]:
        """What rows that meet have in common: the address; without one the whole row, if copies go, else the id."""
        key = email_key(col(email)) if email else F.lit(None).cast("string")
        first = email is None or email == email_columns(rows, self.profile)[0]
        names = rows.drop(SCORE)
        copies = whole_row(names, self.row_id) if first and self.cfg.remove_exact_duplicates else [col(self.row_id)]
        return [key, F.when(key.isNull(), F.struct(*copies))]

    def _best(self, rows: DataFrame, keys: list[Column]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(SCORE), col(self.row_id)))
        return rows.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")

    def _in_buckets(self, rows: DataFrame, keys: list[Column]) -> DataFrame:
        # A struct's hash is that of its fields; one of a missing struct is that of the address alone.
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def _stored(self, folders: dict[str, str], level: int, buckets) -> DataFrame | None:
        """The rows of some buckets; no other folder is looked at."""
        found = [folders[name] for b in buckets if (name := f"{level}/{b}") in folders]
        return self.spark.read.parquet(*[f"{self.store.path}/{f}" for f in found]) if found else None

    def _written(self, rows: DataFrame, level: int, touched: list[int], folders: dict[str, str]) -> DataFrame:
        """Write the touched buckets to new folders, enter these in ``folders``, and read the rows back."""
        folder = self.store.new_folder(f"level{level}")
        spread = F.pmod(F.xxhash64(col(self.row_id)), F.lit(SPREAD))
        rows.repartition(col(BUCKET), spread).write.partitionBy(BUCKET).parquet(f"{self.store.path}/{folder}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.store.path}/{folder}")
        full = {r[0] for r in written.select(BUCKET).distinct().collect()}
        for b in touched:
            folders.pop(f"{level}/{b}", None)
            if b in full:
                folders[f"{level}/{b}"] = f"{folder}/{BUCKET}={b}"
        kept = self._stored(folders, level, touched)
        return rows.drop(BUCKET).limit(0) if kept is None else kept

    def _changes(self, old: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that came and rows that went."""
        if old is None:
            return new, new.limit(0)
        ids = [x.select(col(self.row_id)) for x in (old, new)]
        came, went = new.join(ids[0], self.row_id, "left_anti"), old.join(ids[1], self.row_id, "left_anti")
        return tuple(x.select(*map(col, new.columns)) for x in (came, went))
