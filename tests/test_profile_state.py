"""Profiles from stored counts: the same as from all rows, without reading old ones."""

import math

import pytest
from pyspark.sql import functions as F

from tablecare import ProfileState, TableFacts, profile_table
from tablecare.operators import frequencies
from tablecare.plans import profile_state


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(400).select(
        "id",
        F.when(F.col("id") % 5 != 0, F.lit(2**60) + F.col("id") % 37).alias("big"),
        F.when(F.col("id") % 3 == 0, F.col("id") / 7).otherwise(float("nan")).alias("x"),
        F.when(F.col("id") % 90 == 0, 10**6).otherwise(F.col("id") % 11).cast("decimal(12,2)").alias("d"),
        F.concat(F.lit("w"), F.col("id") % 13).alias("word"),
        F.when(F.col("id") % 4 == 0, F.col("id") % 8 == 0).alias("flag"),
        F.lit(None).cast("string").alias("void"),
        F.timestamp_seconds(F.col("id") % 19).alias("at"),
    )


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12) or a != a and b != b
    return a == b


def same(state, df):
    got, want = (profile_table(t).collect() for t in (state.facts(), df))
    return len(got) == len(want) and all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_additions_in_any_number(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(profile_state, "MOST", 3)
    state = ProfileState(spark, str(tmp_path / "s"))
    for k in range(6):
        state.add(f"part {k}", rows.where(F.col("id") % 6 == k))
        state.add("part 0", rows)
    assert len(state.store.current().folders) <= 3 and same(state, rows)
    assert state.facts().outliers() == TableFacts(rows).outliers()
    assert state.facts().modes == TableFacts(rows).modes
    with pytest.raises(ValueError):
        state.facts().duplicate_rows
    with pytest.raises(ValueError):
        state.add("other", rows.drop("word"))


def test_files_that_are_known_are_not_read_again(spark, rows, tmp_path):
    state = ProfileState(spark, str(tmp_path / "s"))
    files = [str(tmp_path / f"f{k}") for k in range(3)]
    for k, f in enumerate(files):
        rows.where(F.col("id") % 3 == k).write.parquet(f)
    state.add_files(*files[:2])
    # What was read is overwritten with other rows; if it were read again, the profile would differ.
    rows.limit(1).write.mode("overwrite").parquet(files[0])
    state.add_files(*files)
    assert same(state, rows)
    assert state.add_files(*files) == state.store.current()
    assert state.store.current().notes["names"] == files


def test_an_addition_that_fails_counts_once(spark, rows, tmp_path, monkeypatch):
    state = ProfileState(spark, str(tmp_path / "s"))
    state.add("a", rows.where("id < 100"))
    with monkeypatch.context() as m:
        m.setattr(profile_state.Published, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            state.add("b", rows.where("id >= 100"))
    state.add("b", rows.where("id >= 100"))
    assert same(state, rows)


def test_empty_additions(spark, rows, tmp_path):
    state = ProfileState(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        state.facts()
    state.add("none", rows.limit(0))
    assert same(state, rows.limit(0))
    state.add("all", rows)
    assert same(state, rows)


def test_whole_numbers_keep_their_last_digits(spark):
    big = 2**60
    df = spark.createDataFrame([(big + 1,), (big + 1,), (big + 3,), (big + 4,), (5,), (None,)], "x long")
    facts = frequencies.distinct_facts(df, ["x"], [0.0, 0.5, 0.75, 1.0])["x"]
    assert facts == {"unique": 4, "mode": str(big + 1), "quantiles": [5, big + 1, big + 3, big + 4]}
    cents = spark.createDataFrame([("90071992547409.93",), ("90071992547409.94",), ("90071992547409.94",)], "t string")
    cents = cents.select(F.col("t").cast("decimal(18,2)").alias("d"))
    found = frequencies.distinct_facts(cents, ["d"], [0.25, 0.5])["d"]
    assert [str(q) for q in found["quantiles"]] == ["90071992547409.935", "90071992547409.94"]
