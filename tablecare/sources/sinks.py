"""Writing results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tablecare.sources.published import Published


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """A folder of part files; CSV gets a header, quotes doubled inside quotes, and keeps the
    spaces around values, which Spark's writer would cut off."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(
            header=True, quote='"', escape='"',
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    writer.save(path)


def write_clean(df: DataFrame, path: str, fmt: str = "csv") -> None:
    write_table(df, path, fmt)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """One JSON document on one line; ``spark.read.json`` reads it back."""
    text = json.dumps(report, default=str)
    spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def write_lead_outputs(result, path: str, fmt: str = "csv") -> None:
    """``crm_ready/``, ``rejected/`` and ``report/`` under ``path``, all from one staged run."""
    rows = result.settled
    write_table(rows.shown(rows.kept), f"{path}/crm_ready", fmt)
    if rows.rejected.columns:
        write_table(rows.shown(rows.rejected), f"{path}/rejected", fmt)
    write_report(result.spark, result.report(), f"{path}/report")


def publish_lead_outputs(result, path: str, fmt: str = "csv") -> None:
    """The three outputs under ``path`` as one version: readers see those of the last run that came
    to its end, all three, while another is writing or after it has failed."""
    store, rows = Published(result.spark, path), result.settled
    folders = {name: store.new_folder(name) for name in ("crm_ready", "rejected", "report")}
    write_table(rows.shown(rows.kept), f"{path}/{folders['crm_ready']}", fmt)
    if rows.rejected.columns:
        write_table(rows.shown(rows.rejected), f"{path}/{folders['rejected']}", fmt)
    else:
        folders.pop("rejected")
    write_report(result.spark, result.report(), f"{path}/{folders['report']}")
    store.publish(folders, {"format": fmt})


def published_outputs(spark: SparkSession, path: str) -> dict[str, str]:
    """Where the outputs of the last version lie, by name."""
    return {name: f"{path}/{folder}" for name, folder in Published(spark, path).current().folders.items()}
