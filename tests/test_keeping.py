"""Published versions, scopes of staged tables, digests of rows, sketches."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablecare import (
    approximate_quantiles, approximate_types, approximate_unique, count_duplicates, count_duplicates_by_digest,
    drop_exact_duplicates, drop_exact_duplicates_by_digest, process_leads, profile_table, publish_lead_outputs,
    published_outputs, stage, staged_scope,
)
from tablecare.operators import dedupe, sketches
from tablecare.sources import sinks
from tablecare.sources.staging import shared_folder

DATA = "/root/testdata/sf0.001"


def staged_folders(spark):
    folder = f"{shared_folder(spark)}/tablecare"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.mark.parametrize("name", ["profile_table_orders", "quality_issues", "lead_outputs_clean", "csv_quoted_breaks"])
def test_a_scope_leaves_nothing_behind(spark, tmp_path, name):
    before = staged_folders(spark)
    with staged_scope(spark):
        entry.queries()[name](spark, DATA).write.parquet(str(tmp_path / "out"))
        assert staged_folders(spark) > before
    assert staged_folders(spark) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_what_a_scope_keeps(spark):
    before = staged_folders(spark)
    with staged_scope(spark):
        with staged_scope(spark) as inner:
            part = stage(spark.range(5))
            kept = inner.keep(part.where("id > 1"))
        assert kept.count() == 3
        with pytest.raises(ZeroDivisionError):
            with staged_scope(spark):
                stage(spark.range(9))
                1 / 0
        assert len(staged_folders(spark) - before) == 1
    assert staged_folders(spark) == before


def test_outputs_appear_together_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    leads = spark.createDataFrame([(i, f"Ann B{i}", f"a{i}@x.org" if i % 3 else "bad") for i in range(9)], "row_id long, name string, email string")
    assert published_outputs(spark, path) == {}
    publish_lead_outputs(process_leads(leads, row_id="row_id"), path, "parquet")
    first = published_outputs(spark, path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "write_report", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            publish_lead_outputs(process_leads(leads.where("row_id < 4"), row_id="row_id"), path, "parquet")
    assert published_outputs(spark, path) == first
    assert spark.read.parquet(first["crm_ready"]).count() == 6 and spark.read.parquet(first["rejected"]).count() == 3
    publish_lead_outputs(process_leads(leads.where("row_id < 4"), row_id="row_id"), path, "parquet")
    second = published_outputs(spark, path)
    assert spark.read.parquet(second["crm_ready"]).count() == 2
    assert spark.read.json(second["report"]).first()["input_rows"] == 4


@pytest.mark.parametrize("collide,most", [(False, 10**6), (True, 10**6), (False, 0)])
def test_rows_are_never_dropped_for_a_digest(spark, monkeypatch, collide, most):
    monkeypatch.setattr(dedupe, "REPEATED", most)
    if collide:
        digest = {"__d1": F.lit(1).cast("long"), "__d2": F.col("row_id") % 2}
        monkeypatch.setattr(dedupe, "_digested", lambda df, row_id: df.withColumns(digest))
    rows = [(i, f"n{i % 7}", float(i % 5) if i % 4 else None, [i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, name string, x double, a array<int>")
    want = sorted(map(str, drop_exact_duplicates(df, "row_id").select(*df.columns).collect()))
    assert sorted(map(str, drop_exact_duplicates_by_digest(df, "row_id").select(*df.columns).collect())) == want
    assert count_duplicates_by_digest(df, "row_id").first() == count_duplicates(df, "row_id").first()
    assert count_duplicates_by_digest(df.limit(0), "row_id").first()["total_rows"] == 0


def test_sketches_keep_their_bounds(spark):
    tables = {n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("orders", "customer")}
    for name, df in tables.items():
        db = duckdb.connect()
        for column, (values, low, high) in approximate_unique(df).items():
            exact = db.execute(f'SELECT count("{column}"), count(DISTINCT "{column}") FROM \'/root/testdata/sf0.01/{name}.parquet\'').fetchone()
            assert values == exact[0] and low <= exact[1] <= high
    prices = sorted(r[0] for r in tables["orders"].select("o_totalprice").collect())
    asked = [0.01, 0.25, 0.5, 0.9, 0.999]
    for p, x in zip(asked, approximate_quantiles(tables["orders"], ["o_totalprice"], asked)["o_totalprice"]):
        ranks = [i / len(prices) for i, v in enumerate(prices) if v == x]
        assert min(abs(r - p) for r in ranks) <= sketches.RANK_ERROR


def test_types_of_columns_near_the_borders(spark):
    df = spark.range(2000).select(
        F.concat(F.lit("a"), F.when(F.col("id") < 1801, F.col("id")).otherwise(0)).alias("just_an_identifier"),
        F.concat(F.lit("a"), F.when(F.col("id") < 1800, F.col("id")).otherwise(0)).alias("just_not"),
        F.concat(F.lit("b"), F.col("id") % 20).alias("twenty"),
        F.concat(F.lit("b"), F.col("id") % 21).alias("twenty_one"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.lit(None).cast("string").alias("void"),
        F.col("id").alias("number"),
        F.to_date(F.timestamp_seconds(F.col("id") * 86400)).alias("day"),
    )
    want = {r["column"]: r["inferred_type"] for r in profile_table(df).collect()}
    got = {r["column"]: r["inferred_type"] for r in approximate_types(df).collect()}
    assert got == want and {"identifier", "freetext", "categorical", "empty", "numeric"} <= set(got.values())
    assert approximate_types(df.limit(0)).count() == 8
    assert approximate_quantiles(df.limit(0), ["number"], [0.5]) == {"number": None}
