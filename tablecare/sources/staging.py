"""Tables written to the cluster's shared folder, and row ids fixed that way.

A staged table is plain parquet in the folder that ``spark.checkpoint.dir`` names, or, where that
is unset, in the session's warehouse. Both are folders that all executors share. It outlives
executors, its rows never change on a re-run, and later jobs read only the columns they need.

Tables staged inside ``with staged_scope(spark):`` are removed at its end, so results that read them
must be written, or kept by ``scope.keep``, before. Without a scope whoever owns the folder clears it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar, copy_context

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: The file and the block of a row, where a reader has kept them.
PLACE = ("__file", "__block")
#: The line of the block that a row begins with, where it is known; else rows follow their block's order.
LINE = "__line"


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


class Scope:
    """What has been staged since it was entered."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, label: str = "kept") -> DataFrame:
        """``df`` as a staged table that outlives the scope; enclosing scopes remove it in the end."""
        outer = self._outer
        path = _named(self.spark, label)
        if outer is not None:
            outer.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> "Scope":
        self._outer = _scope.get()
        self._token = _scope.set(self)
        return self

    def __exit__(self, *error) -> None:
        _scope.reset(self._token)
        for path in self.paths:
            _remove(self.spark, path)


_scope: ContextVar[Scope | None] = ContextVar("staged_scope", default=None)


def staged_scope(spark: SparkSession) -> Scope:
    """A context at whose end the tables staged in it are removed, whether it failed or not."""
    return Scope(spark)


def in_scope(work: Callable) -> Callable:
    """``work`` for another thread, staging into this one's scope."""
    context = copy_context()
    return lambda *args: context.run(work, *args)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _named(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tablecare/{label}-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, label: str) -> str:
    """A folder that nothing has been written to yet; the scope, if there is one, removes it."""
    path = _named(spark, label)
    if (scope := _scope.get()) is not None:
        scope.paths.append(path)
    return path


def stage(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write ``df`` once and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """``df``, staged, with a row id that grows in reading order.

    The order is that of file paths, of blocks in a file, and of rows in a block, whatever the
    sizes of files and splits; Spark itself packs files by size. Tables that do not come straight
    from files are numbered in the order of their partitions. Ids made on the fly would depend on
    how a run cuts the input; staged ones never change.
    """
    if any(n.lower() == name.lower() for n in df.columns):
        raise ValueError(f"column {name!r} exists already")
    number = F.monotonically_increasing_id()
    if not set(PLACE) <= set(df.columns):
        try:
            df = df.select(
                "*", *(F.col(f"_metadata.{m}").alias(p) for m, p in zip(("file_path", "file_block_start"), PLACE))
            )
        except AnalysisException:
            return stage(df.withColumn(name, number), "rows")
    rows = stage(df.withColumn("__number", number), "rows")
    # One row for each block: which it is, and the number of its first row.
    blocks = (
        rows.groupBy(*PLACE)
        .agg(F.min("__number").alias("__first"))
        .withColumn("__nth", F.row_number().over(Window.orderBy(*PLACE)).cast("long"))
    )
    inside = F.col("__number") - F.col("__first")
    if LINE in rows.columns:
        inside = F.coalesce(LINE, inside)
    row_id = F.shiftleft(F.col("__nth") - 1, 33) + inside
    return rows.join(blocks, list(PLACE)).withColumn(name, row_id).drop(*PLACE, LINE, "__number", "__first", "__nth")
