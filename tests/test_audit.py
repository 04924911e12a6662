"""Profiles, quality, cleaning, coercion, reports, and the whole audit."""

import json
import re
import random
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog.profiles import profile_quantiles_narrowed
from tablecare import (
    TableFacts, audit_csv, audit_table, clean, coerce_types, filter_columns, handle_missing,
    profile_table, quality_score, quality_summary, run_quality_checks, suggest, value_frequencies,
)
from tablecare.operators import frequencies, quality
from tablecare.operators.coerce import Change


@pytest.fixture(scope="module")
def people(spark):
    """Five rows, two numeric columns with two gaps each."""
    return spark.createDataFrame(
        [("a", 30.0, None), ("b", None, 100.0), ("c", 40.0, 300.0), ("d", None, None), ("e", 50.0, 200.0)],
        "name STRING, age DOUBLE, pay DOUBLE",
    )


def by_column(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


# --- frequencies and quantiles ---------------------------------------------------


def test_frequencies_count_every_type(spark):
    df = spark.sql(
        "SELECT * FROM VALUES "
        "(9007199254740993L, 1.5D, 'x', true, DATE'2024-01-01', TIMESTAMP'2024-01-01 01:02:03', "
        " TIMESTAMP_NTZ'2024-01-01 01:02:03', array(1, 2), map('a', 1, 'b', 2), 1.10, X'00FF'), "
        "(9007199254740992L, double('NaN'), 'X', false, DATE'2024-01-01', NULL, NULL, array(2, 1), "
        " map('b', 2, 'a', 1), 1.1, X'00FF'), "
        "(9007199254740993L, -0.0D, NULL, NULL, NULL, TIMESTAMP'2024-01-01 01:02:03', "
        " TIMESTAMP_NTZ'2024-01-01 01:02:04', NULL, NULL, NULL, NULL) "
        "AS t(big, dbl, txt, flag, day, ts, ntz, arr, mp, num, bin)"
    )
    found = {r["column"]: r["unique"] for r in frequencies.unique_counts(df).collect()}
    assert found == {
        "big": 2, "dbl": 2, "txt": 2, "flag": 2, "day": 1, "ts": 1, "ntz": 2, "arr": 2, "mp": 1,
        "num": 1, "bin": 1,
    }
    facts = TableFacts(df)
    assert facts.unique == found and facts.nulls("dbl") == 1
    values = value_frequencies(df, ["txt", "big"]).collect()
    assert sorted((r["column"], r["value"], r["n"]) for r in values) == [
        ("big", "9007199254740992", 1), ("big", "9007199254740993", 2), ("txt", "X", 1), ("txt", "x", 1),
    ]


def test_quartiles_equal_pandas(spark):
    df = spark.range(501).select(
        (F.col("id") % 37).alias("whole"), (F.col("id") % 11 / 4).alias("part"),
        (F.col("id") % 13).cast("decimal(9,2)").alias("money"),
        F.when(F.col("id") > 400, F.col("id")).alias("gaps"), F.lit("x").alias("text"),
    )
    facts = TableFacts(df)
    frame = df.toPandas()[["whole", "part", "money", "gaps"]].astype(float)
    for n in frame.columns:
        assert facts.quartiles[n] == pytest.approx(list(frame[n].quantile([0.25, 0.5, 0.75])))
    assert facts.unique == {"whole": 37, "part": 11, "money": 13, "gaps": 100, "text": 1}


def test_modes_take_the_smallest_on_a_tie(spark):
    df = spark.sql("SELECT * FROM VALUES ('b','q'), ('a','q'), ('b',NULL), ('a',NULL), (NULL,'p') AS t(t, u)")
    assert {r["column"]: r["mode"] for r in frequencies.modes(df, ["t", "u"]).collect()} == {
        "t": "a", "u": "q",
    }


def arrays(seed):
    rng = np.random.default_rng(seed)
    n = 3000
    return {
        "uniform": rng.uniform(-5, 5, n),
        "ties": rng.choice([1.0, 2.0, 3.0], n, p=[0.4, 0.2, 0.4]),
        "one": np.full(n, 7.0),
        "wild": np.where(rng.random(n) < 0.01, 1e300, rng.lognormal(0, 9, n)),
        "edges": np.where(rng.random(n) < 0.3, -np.inf, rng.integers(0, 50, n)),
    }


def test_quartiles_of_whole_numbers_and_decimals_are_doubles(spark, tmp_path):
    rows = [(1, Decimal("1.00"), 0.5), (2, Decimal("2.01"), None), (4, Decimal("4.00"), 1.5), (3, None, None)]
    df = spark.createDataFrame(rows, "l_orderkey BIGINT, l_quantity DECIMAL(15,2), l_extendedprice DOUBLE")
    df = df.selectExpr("*", "CAST(l_orderkey AS INT) AS l_discount", "CAST(NULL AS DECIMAL(15,2)) AS l_tax")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = profile_quantiles_narrowed(spark, str(tmp_path))
    assert {f.name: f.dataType.simpleString() for f in found.schema}["q1"] == "double"
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {
        "l_orderkey": (1.75, 2.5, 3.25), "l_quantity": (1.505, 2.01, 3.005), "l_extendedprice": (0.75, 1.0, 1.25),
        "l_discount": (1.75, 2.5, 3.25), "l_tax": (None, None, None),
    }


@pytest.mark.parametrize("partitions", [1, 7])
def test_quantiles_equal_numpy(spark, partitions):
    data = arrays(3)
    df = spark.createDataFrame(pd.DataFrame(data)).withColumn("few", F.when(F.col("one") < 0, 1.0))
    df = df.withColumn("single", F.when(F.monotonically_increasing_id() == 0, 3.0)).repartition(partitions)
    wanted = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = frequencies.distinct_facts(df, df.columns, wanted)
    assert "few" not in found and found["single"]["quantiles"] == [3.0] * 6
    for n, values in data.items():
        assert found[n]["unique"] == len(set(values.tolist()))
        finite = np.sort(values)
        for p, got in zip(wanted, found[n]["quantiles"]):
            pos = p * (len(finite) - 1)
            low, high = finite[int(np.floor(pos))], finite[int(np.ceil(pos))]
            expected = low if low == high else low + (high - low) * (pos - np.floor(pos))
            assert got == pytest.approx(expected, rel=1e-12, nan_ok=True), (n, p)


def test_modes_of_times(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (DATE'2024-02-01', TIMESTAMP_NTZ'2024-01-01 01:02:03.5', 1.10), "
        "(DATE'2024-02-01', TIMESTAMP_NTZ'2024-01-01 01:02:03.5', 2.00), (NULL, TIMESTAMP_NTZ'1950-01-01 00:00:00', 2.00) AS t(d, t, m)"
    )
    found = frequencies.distinct_facts(df, ["d", "t", "m"])
    assert {n: f["mode"] for n, f in found.items()} == {"d": "2024-02-01", "t": "2024-01-01 01:02:03.5", "m": "2.00"}


# --- profile ---------------------------------------------------------------------


def test_profile_of_gaps(people):
    rows = by_column(profile_table(people))
    assert rows["age"] == {
        "column": "age", "dtype": "double", "inferred_type": "numeric", "total": 5, "non_null": 3,
        "null_count": 2, "null_pct": 40.0, "unique": 3, "mean": 40.0, "median": 40.0, "min": 30.0,
        "max": 50.0,
    }
    assert rows["name"]["inferred_type"] == "identifier" and rows["name"]["mean"] is None


def test_inferred_types(spark):
    df = spark.range(100).select(
        F.lit(None).cast("string").alias("empty"),
        (F.col("id") % 2 == 0).alias("flag"),
        (F.col("id") % 20).cast("string").alias("cat"),
        (F.col("id") % 21).cast("string").alias("free"),
        F.col("id").cast("string").alias("key"),
        F.array("id").alias("nested"),
        F.when(F.col("id") < 0, F.lit(1.0)).alias("no_numbers"),
        F.lit(float("nan")).alias("nans"),
    )
    rows = by_column(profile_table(df))
    assert {n: r["inferred_type"] for n, r in rows.items()} == {
        "empty": "empty", "flag": "categorical", "cat": "categorical", "free": "freetext",
        "key": "identifier", "nested": "nested", "no_numbers": "empty", "nans": "empty",
    }


def test_empty_table(people):
    none = people.limit(0)
    rows = by_column(profile_table(none))
    assert {r["inferred_type"] for r in rows.values()} == {"empty"} and rows["age"]["null_pct"] == 0
    assert quality.score_of(TableFacts(none))["score"] == 0.0
    assert suggest(none).count() == 0
    assert handle_missing(none).rows == 0 and coerce_types(none).changes == []


# --- quality ---------------------------------------------------------------------


def test_missing_is_critical_beyond_thirty_percent(spark, people):
    issues = [i for i in quality.quality_issues(people) if i["check"] == "missing_values"]
    assert [(i["column"], i["severity"], i["message"], i["affected"]) for i in issues] == [
        ("age", "critical", "2 of 5 values are absent", 2), ("pay", "critical", "2 of 5 values are absent", 2),
    ]
    # Limits are strict: exactly 30 and exactly 5 percent stay below the next step.
    edge = spark.range(100).select(
        F.when(F.col("id") >= 30, F.col("id")).alias("at30"), F.when(F.col("id") >= 5, F.col("id")).alias("at5"),
        F.when(F.col("id") >= 31, F.col("id")).alias("at31"),
    )
    found = {i["column"]: i["severity"] for i in quality.quality_issues(edge, checks=("missing_values",))}
    assert found == {"at30": "warning", "at31": "critical"}


@pytest.fixture(scope="module")
def flawed(spark):
    df = spark.range(60).select(
        F.when(F.col("id") == 59, 10_000.0).otherwise(F.col("id").cast("double")).alias("wild"),
        F.lit("same").alias("constant"),
        F.when(F.col("id") % 10 != 0, (F.col("id") * 2).cast("string")).alias("code"),
        (F.col("id") % 55).cast("string").alias("many"),
    )
    return df.unionByName(df.limit(6))


def test_issues_in_order_and_summary(flawed):
    issues = quality.quality_issues(flawed)
    assert [(i["check"], i["column"], i["affected"]) for i in issues] == [
        ("missing_values", "code", 7), ("duplicates", "all columns", 6),
        ("constant_column", "constant", 66), ("outliers", "wild", 1),
    ]
    summary = quality_summary(run_quality_checks(flawed)).first().asDict()
    assert summary == {"critical": 0, "warning": 4, "info": 0, "total": 4}
    assert not [
        i for i in quality.quality_issues(flawed, {"enable_outlier_checks": False}) if i["check"] == "outliers"
    ]
    strict = quality.quality_issues(flawed, {"outlier_iqr_factor": 1000.0})
    assert not [i for i in strict if i["check"] == "outliers"]


def test_score_is_the_sum_of_its_penalties(flawed):
    row = quality_score(flawed).first()
    expected = 100 - 7 / (66 * 4) * 100 * 0.4 - 6 / 66 * 100 * 0.2 - 5 - 3
    assert row["score"] == round(expected, 2) and row["grade"] == "Excellent"
    assert row["constant_penalty"] == 5.0 and row["outliers_penalty"] == 3.0


def test_score_caps(spark):
    df = spark.range(3).select(*[F.lit(None).cast("string").alias(f"c{i}") for i in range(9)])
    row = quality_score(df).first()
    assert (row["missing_penalty"], row["constant_penalty"]) == (40.0, 20.0)
    assert row["duplicates_penalty"] == pytest.approx(2 / 3 * 20)


@pytest.mark.parametrize(
    "score, label, grade, status",
    [
        (95, "Excellent", "A+ (Excellent)", "HEALTHY"), (94.99, "Excellent", "A (Very Good)", "HEALTHY"),
        (85, "Excellent", "B (Good)", "REVIEW"), (79.9, "Good", "C (Fair)", "NEEDS ATTENTION"),
        (60, "Moderate", "D (Poor)", "NEEDS ATTENTION"), (49.9, "Poor", "F (Critical)", "NEEDS ATTENTION"),
    ],
)
def test_labels(score, label, grade, status):
    assert quality.score_label(score) == label
    assert quality.report_grade(score) == grade and quality.report_status(score) == status
    assert quality.report_grade(score, 1) == "CRITICAL"
    assert quality.report_status(score, 1) == "ACTION REQUIRED"


def test_infinite_quartiles_have_no_fences(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("inf"),), (1.0,), (float("-inf"),)], "x DOUBLE")
    assert TableFacts(df).outliers() == {"x": 0}


def test_suggestions_sorted_by_severity(flawed):
    rows = suggest(flawed).orderBy("place").collect()
    assert [(r["type"], r["severity"], r["scope"]) for r in rows] == [
        ("missing_values", "medium", "code"), ("duplicates", "medium", "dataset"),
        ("constant_column", "medium", "constant"), ("outliers", "medium", "wild"),
        ("type_conversion", "low", "code"), ("type_conversion", "low", "many"),
        ("high_cardinality", "low", "many"),
    ]
    assert rows[4]["message"] == "100 % of the texts in code are numbers"
    assert re.fullmatch(r"Put its commonest value \(\d+\) or a word of their own into the 7 gaps\.", rows[0]["action"])


# --- cleaning --------------------------------------------------------------------


def test_useless_columns(spark):
    df = spark.range(10).select(
        "id", F.lit("x").alias("constant"), F.when(F.col("id") < 4, 1).alias("sixty"),
        F.when(F.col("id") < 3, F.col("id")).alias("seventy"), F.lit(1).alias("Listed"),
    )
    done = filter_columns(df, {"force_drop_columns": ("listed", "missing")})
    assert [(d["column"], d["reason"]) for d in done.dropped_columns] == [
        ("Listed", "force_drop"), ("seventy", "70.0 % absent, more than 60 %"),
        ("constant", "single_unique_value"), ("sixty", "single_unique_value"),
    ]
    assert done.df.columns == ["id"]
    assert "constant" in filter_columns(df.limit(9)).df.columns


def test_fill_strategies(spark, people):
    def fill(**cfg):
        done = handle_missing(people, cfg)
        return [r["pay"] for r in done.df.orderBy("name").collect()], done

    assert fill()[0] == [200.0, 100.0, 300.0, 200.0, 200.0]
    assert fill(numeric_strategy="constant", numeric_fill_value=-1)[0][0] == -1.0
    mean, done = fill(numeric_strategy="mean")
    assert mean[0] == 200.0
    assert done.actions[0] == {
        "column": "age", "action": "filled_mean", "fill_value": 40.0, "nulls_filled": 2,
    }
    _, done = fill(numeric_strategy="nonsense")
    assert done.actions[0]["action"] == "no_action"
    assert done.df.filter("age IS NULL").count() == 2


def test_median_of_whole_numbers_is_not_cut(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, 1), (2L, 2), (NULL, NULL) AS t(a, b)")
    done = handle_missing(df)
    assert [r["a"] for r in done.df.orderBy("a").collect()] == [1.0, 1.5, 2.0]
    kept = handle_missing(df, {"numeric_strategy": "constant"})
    assert dict(kept.df.dtypes) == {"a": "bigint", "b": "int"}


def test_categorical_families(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (true, 'b', array(1)), (false, 'a', NULL), (NULL, NULL, array(2)), "
        "(true, 'a', array(2)) AS t(flag, word, list)"
    )
    done = handle_missing(df)
    assert {a["column"]: a["action"] for a in done.actions} == {
        "flag": "filled_mode", "word": "filled_mode", "list": "no_action",
    }
    assert done.df.filter("flag IS NULL OR word IS NULL").count() == 0
    assert dict(done.df.dtypes)["flag"] == "boolean"
    constant = handle_missing(df, {"categorical_strategy": "constant"}).df
    assert sorted(r["flag"] for r in constant.collect()) == ["Unknown", "false", "true", "true"]


def test_sparse_columns_are_skipped(spark):
    df = spark.range(10).select(
        F.when(F.col("id") < 3, F.col("id")).alias("n"), F.when(F.col("id") < 4, "x").alias("s"),
    )
    done = handle_missing(df)
    assert done.actions[0] == {"column": "n", "action": "skipped", "reason": "null_ratio_too_high"}
    assert done.actions[1]["action"] == "filled_mode"


def test_times_are_dropped_or_flagged(spark):
    df = spark.createDataFrame(
        [(1.0, datetime(2024, 1, 1), date(2024, 1, 1)), (2.0, None, date(2024, 1, 1)), (None, datetime(2024, 1, 2), None)],
        "x DOUBLE, t TIMESTAMP, d DATE",
    )
    done = handle_missing(df)
    assert (done.rows, done.rows_dropped, done.df.count()) == (1, 2, 1)
    assert [a.get("rows_removed") for a in done.actions] == [None, 1, 1]
    flagged = handle_missing(df, {"datetime_strategy": "flag"})
    assert flagged.df.columns == ["x", "t", "d", "t__was_null", "d__was_null"]
    assert flagged.rows_dropped == 0


def sequential_clean(frame, numeric, words, limit):
    """Rows dropped column by column, each ratio taken from what is left; then modes."""
    actions = []
    for n in [*numeric, *words]:
        missing = frame[n].isna()
        if not missing.any():
            continue
        if missing.mean() > limit:
            actions.append((n, "skipped", None))
            continue
        actions.append((n, "drop_rows", int(missing.sum())))
        frame = frame[~missing]
    return frame, actions


@pytest.mark.parametrize("seed", range(4))
def test_dropping_rows_in_sequence_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    records = [
        tuple(
            None if rnd.random() < share else value
            for share, value in zip((0.2, 0.55, 0.62, 0.5, 0.3), (1.0, 2.0, 3.0, "u", "v"))
        )
        for _ in range(300)
    ]
    names = ["a", "b", "c", "s", "t"]
    df = spark.createDataFrame(records, "a DOUBLE, b DOUBLE, c DOUBLE, s STRING, t STRING")
    cfg = {"numeric_strategy": "drop_rows", "categorical_strategy": "drop_rows"}
    done = handle_missing(df, cfg)
    left, actions = sequential_clean(pd.DataFrame(records, columns=names), "abc", "st", 0.6)
    assert [(a["column"], a["action"], a.get("rows_removed")) for a in done.actions] == actions
    assert done.rows == len(left) == done.df.count()
    assert done.rows_dropped == 300 - len(left)


def test_clean_log(flawed):
    assert clean(flawed).log() == [
        "constant left out: single_unique_value", "code: filled_mode",
    ]


# --- coercion --------------------------------------------------------------------


def coerced(table, values, config=None):
    done = coerce_types(table(v=values), config)
    return done, [r["v"] for r in done.df.collect()]


def test_bool_before_number(table):
    done, values = coerced(table, ["1", "0", None, " 1 "])
    assert done.changes == [Change("v", "string", "boolean", "bool", 1.0)]
    assert values == [True, False, None, True]
    assert coerced(table, ["yes", "no", "maybe"])[0].changes == []


def test_numbers(table):
    done, values = coerced(table, ["1", "2.0", "-3"] * 10 + ["x"])
    assert (done.changes[0].to_dtype, values[:3], values[-1]) == ("bigint", [1, 2, -3], None)
    assert done.changes[0].success_rate == pytest.approx(30 / 31)
    assert coerced(table, ["1", "2", "x"])[0].changes == []
    assert coerced(table, ["1.5", "2"])[1] == [1.5, 2.0]
    assert coerced(table, ["inf", "2"])[0].changes[0].to_dtype == "double"
    assert coerced(table, ["9007199254740993", "10"])[1] == [9007199254740993, 10]
    assert coerced(table, [None, None])[0].attempts == []


@pytest.mark.parametrize(
    "values, first",
    [
        (["2024-03-05", "2023-12-31"], datetime(2024, 3, 5)),
        (["2024-03-05 07:08:09", "2023-12-31 00:00:00"], datetime(2024, 3, 5, 7, 8, 9)),
        (["2024-03-05T07:08:09.125Z", "2023-12-31T00:00:00+00:00"], datetime(2024, 3, 5, 7, 8, 9, 125000)),
        (["3/5/2024", "12/31/2023"], datetime(2024, 3, 5)),
        (["5/3/2024", "31/12/2023"], datetime(2024, 3, 5)),
        (["1/2/2024", "3/4/2023"], datetime(2024, 1, 2)),
        (["5 Mar 2024", "31 Dec 2023"], datetime(2024, 3, 5)),
        (["March 5, 2024", "December 31, 2023"], datetime(2024, 3, 5)),
    ],
)
def test_timestamps(table, values, first):
    done, out = coerced(table, values)
    assert done.changes[0].cast_type == "datetime" and out[0] == first
    assert all(v is not None for v in out)


def test_timestamps_need_nine_in_ten_of_one_format(table):
    assert coerced(table, ["2024-01-01"] * 9 + ["soon"])[0].changes[0].success_rate == 0.9
    mixed = ["2024-01-01"] * 5 + ["1/2/2024"] * 5
    done, _ = coerced(table, mixed)
    assert done.changes == []
    assert [(a.cast_type, a.parsed, a.accepted) for a in done.attempts] == [
        ("bool", 0, False), ("numeric", 0, False), ("datetime", 5, False),
    ]


def test_partial_settings_leave_the_rest_on(table):
    done, _ = coerced(table, ["y", "n"], {"coerce_to_numeric": False})
    assert done.changes[0].cast_type == "bool"
    assert coerced(table, ["oui", "non"], {"bool_true_values": ("OUI",), "bool_false_values": ("non",)})[1] == [
        True, False,
    ]
    off = {"coerce_to_bool": False, "coerce_to_numeric": False, "coerce_to_datetime": False}
    assert coerced(table, ["1", "0"], off)[0].changes == []


# --- the whole audit -------------------------------------------------------------


def test_audit_of_a_csv(spark, tmp_path):
    lines = ["id; Amount ;when;ok;note"] + [
        f"{i};{'' if i % 4 == 0 else i * 1.5};2024-01-{i % 28 + 1:02d};{'yes' if i % 2 else 'no'};same"
        for i in range(40)
    ] + ["40;1;2024-01-01;yes;same;too;long", "41;2"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines) + "\n\n")
    result = audit_csv(spark, str(tmp_path / "in"), save_clean=str(tmp_path / "out"))
    assert dict(result.clean_df.dtypes) == {
        "id": "bigint", "Amount": "double", "when": "timestamp_ntz", "ok": "boolean",
    }
    assert result.summary == {
        "rows_before": 41, "rows_after": 41, "rows_lost": 0, "columns_before": 5, "columns_after": 4,
        "columns_lost": 1, "columns_cast": 2, "score": result.score["score"], "label": "Excellent",
    }
    assert result.report["load"]["delimiter"] == ";"
    assert result.report["load"]["malformed_rows"] == 1
    assert result.clean_log[0] == "note left out: single_unique_value"
    assert result.report["cleaning"]["filled"] == 3
    assert (result.report["types"]["to_datetime"], result.report["types"]["to_bool"]) == (["when"], ["ok"])
    assert set(result.report) == {"size", "score", "columns", "issues", "advice", "cleaning", "types", "load"}
    assert result.report_df().filter("section = 'size' AND item = 'rows_after'").first()["value"] == "41"
    json.dumps(result.report, default=str)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 41
    assert result.issues_df().count() == len(result.issues)
    assert result.profile_df().count() == 5
    assert result.summary_df().first()["label"] == "Excellent"


def test_audit_without_cleaning(people):
    result = audit_table(people, {"skip_clean": True})
    assert result.clean_df.columns == people.columns
    assert result.summary["rows_after"] == 5 and result.clean_log == []
    assert result.report["score"]["grade"] == "CRITICAL"
    assert result.report["score"]["status"] == "ACTION REQUIRED"
    hidden = audit_table(people, {"report": {"show_cleaning_summary": False}})
    assert "cleaning" not in hidden.report


def test_result_does_not_depend_on_partitions(flawed):
    one, many = audit_table(flawed.coalesce(1)), audit_table(flawed.repartition(9))
    assert one.summary == many.summary and one.issues == many.issues
    assert one.suggestions == many.suggestions
    assert sorted(map(str, one.clean_df.collect())) == sorted(map(str, many.clean_df.collect()))
