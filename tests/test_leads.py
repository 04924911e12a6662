"""Formatting, validation and deduplication, each with a profile stated by hand, and the plan."""

import json
import random

import pytest
from pyspark.sql import DataFrame, functions as F

from tablecare import (
    SemanticProfile, check_stream, count_duplicates, dedupe_by_email, deduplicate_leads,
    drop_exact_duplicates, format_changes, format_leads, process_leads, read_leads, validate_leads,
    write_lead_outputs,
)
from tablecare.functions.emails import email_key
from tablecare.operators.dedupe import completeness, dedup_report


def profile(**types):
    return SemanticProfile.of(types)


def rows(df: DataFrame, *names):
    df = df.orderBy("row_id") if "row_id" in df.columns else df
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def one(df):
    return df.first().asDict()


# --- formatting ----------------------------------------------------------------


def test_format_all_steps(numbered):
    df = numbered(
        name=["GRACE  HOPPER", None, "cher", "  ", "Ada Byron King"],
        email=[" G@X.ORG ", None, "c@y.org", "", "a@z.org"],
        note=["  Keep CASE ", "x", None, " ", "d'x"],
    )
    p = profile(name="full_name", email="email", note="unknown")
    out = format_leads(df, p, row_id="row_id")
    assert out.columns == ["row_id", "name", "first_name", "last_name", "email", "note"]
    assert rows(out, "name", "first_name", "last_name", "email", "note") == [
        ("Grace Hopper", "Grace", "Hopper", "g@x.org", "Keep CASE"),
        (None, None, None, None, "x"),
        ("Cher", "Cher", "", "c@y.org", None),
        ("", "", "", "", ""),
        ("Ada Byron King", "Ada", "Byron King", "a@z.org", "d'x"),
    ]
    assert one(format_changes(df, p, row_id="row_id")) == {
        "whitespace_fixes": 4, "name_fields_formatted": 2, "email_fields_normalized": 1,
        "full_names_split": 3,
    }
    again = format_leads(out, p, row_id="row_id")
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


@pytest.mark.parametrize("existing", ["first_name", "last_name", "First_Name"])
def test_split_skipped_when_a_target_exists(numbered, existing):
    df = numbered(name=["Ada King"], **{existing: ["x"]})
    out = format_leads(df, profile(name="full_name"))
    assert out.columns == df.columns
    assert one(format_changes(df, profile(name="full_name")))["full_names_split"] == 0


def test_only_the_first_full_name_is_split(numbered):
    df = numbered(a=["Ada King"], b=["Bob Roe"])
    out = format_leads(df, profile(a="full_name", b="full_name"))
    assert out.columns == ["row_id", "a", "first_name", "last_name", "b"]


def test_format_switches(numbered):
    df = numbered(name=[" ADA  KING "], email=[" A@X.org "])
    p = profile(name="full_name", email="email")
    off = dict(split_full_names=False, normalize_emails=False, title_case_names=False,
               trim_whitespace=False)
    assert rows(format_leads(df, p, off), "name", "email") == [(" ADA  KING ", " A@X.org ")]
    assert rows(format_leads(df, p, {**off, "trim_whitespace": True}), "name") == ["ADA  KING"]
    assert rows(format_leads(df, p, {**off, "title_case_names": True}), "name") == ["Ada King"]
    assert rows(format_leads(df, p, {**off, "split_full_names": True}), "first_name", "last_name") == [
        ("ADA", "KING")
    ]
    with pytest.raises(ValueError):
        format_leads(df, p, {"no_such_setting": True})


# --- validation ----------------------------------------------------------------


def test_validation_counts_and_reasons(numbered):
    df = numbered(email=["ok@x.org", "Info@x.org", None, "  ", "bad", "a@b", "z@q.io"])
    split = validate_leads(df, profile(email="email"))
    assert rows(split.valid, "row_id", "is_role_email") == [(0, False), (1, True), (6, False)]
    assert rows(split.rejected, "row_id", "rejection_reason") == [
        (2, "BLANK_EMAIL"), (3, "BLANK_EMAIL"), (4, "INVALID_EMAIL_FORMAT"), (5, "INVALID_DOMAIN"),
    ]
    assert "rejection_reason" not in split.valid.columns
    assert "is_role_email" not in split.rejected.columns
    assert one(split.report) == {
        "total_rows": 7, "valid_rows": 3, "rejected_rows": 4, "invalid_email_count": 2,
        "blank_email_count": 2, "role_based_email_count": 1,
    }


def test_two_email_columns_reject_once_and_flag_any(numbered):
    df = numbered(
        a=["x@x.org", "bad", "sales@x.org", "help@x.org", "y@y.org"],
        b=["y@y.org", None, "bad", "info@x.org", "team@y.org"],
    )
    split = validate_leads(df, profile(a="email", b="email"))
    assert rows(split.rejected, "row_id", "rejection_reason") == [
        (1, "INVALID_EMAIL_FORMAT"), (2, "INVALID_EMAIL_FORMAT"),
    ]
    assert rows(split.valid, "is_role_email") == [False, True, True]
    # Role addresses count per cell, on rejected rows too.
    assert one(split.report)["role_based_email_count"] == 4


def test_validation_switches(numbered):
    df = numbered(email=[None, "bad", "info", "ok@x.org"])
    p = profile(email="email")
    assert rows(validate_leads(df, p, {"reject_blank_emails": False}).valid, "row_id") == [0, 3]
    loose = validate_leads(df, p, {"strict_email_validation": False})
    assert rows(loose.valid, "row_id", "is_role_email") == [(1, False), (2, True), (3, False)]
    quiet = validate_leads(df, p, {"flag_role_accounts": False})
    assert "is_role_email" not in quiet.valid.columns
    assert one(quiet.report)["role_based_email_count"] == 0
    both = validate_leads(df, p, {"reject_blank_emails": False, "strict_email_validation": False})
    assert both.rejected.count() == 0 and both.valid.count() == 4


def test_no_email_column_and_no_rows(numbered):
    df = numbered(name=["a", "b"])
    split = validate_leads(df, profile(name="full_name"))
    assert split.valid.count() == 2 and split.rejected.count() == 0
    empty = validate_leads(df.limit(0).withColumn("email", F.lit("")), profile(email="email"))
    assert one(empty.report)["total_rows"] == 0


# --- deduplication -------------------------------------------------------------


def test_exact_duplicates_keep_the_first_and_nulls_are_equal(numbered):
    df = numbered(a=["x", None, "x", None, "y"], b=["1", None, "1", None, "1"])
    assert rows(drop_exact_duplicates(df, "row_id"), "row_id") == [0, 1, 4]
    assert one(count_duplicates(df, "row_id")) == {
        "total_rows": 5, "duplicate_rows": 2, "distinct_rows": 3,
    }
    assert one(count_duplicates(df.limit(0), "row_id"))["total_rows"] == 0


def test_duplicates_with_maps_and_nan(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (0, map('a', 1, 'b', 2), double('NaN')), (1, map('b', 2, 'a', 1), "
        "double('NaN')), (2, map('a', 1), 1.0) AS t(row_id, m, x)"
    )
    assert rows(drop_exact_duplicates(df, "row_id"), "row_id") == [0, 2]
    assert one(count_duplicates(df, "row_id"))["duplicate_rows"] == 1


def test_fullest_row_wins_earliest_on_a_tie(numbered):
    df = numbered(
        email=["A@x.org", "a@X.org ", "b@x.org", "B@x.org", None, "", None],
        name=["n", "n", "first", "second", "same", "same", "same"],
        phone=[" ", "1", "2", "3", None, None, None],
    )
    assert rows(dedupe_by_email(df, "email", "row_id"), "row_id") == [1, 2, 4, 5, 6]
    out = deduplicate_leads(df, profile(email="email"))
    # Rows 4 and 6 are copies of each other; 5 differs ('' is not NULL).
    assert rows(out, "row_id") == [1, 2, 4, 5]
    assert one(dedup_report(df, out)) == {
        "input_rows": 7, "output_rows": 4, "exact_duplicates_removed": 1,
        "email_duplicates_removed": 2, "rows_retained": 4,
    }
    assert rows(df.select("row_id", completeness(df, "row_id").alias("s")), "s") == [
        2, 3, 3, 3, 1, 1, 1,
    ]


def test_dedup_switches(numbered):
    df = numbered(email=["a@x.org", "a@x.org", "A@x.org"], name=["n", "n", "m"])
    p = profile(email="email")
    assert deduplicate_leads(df, p, {"remove_exact_duplicates": False}).count() == 1
    assert deduplicate_leads(df, p, {"remove_email_duplicates": False}).count() == 2
    off = {"remove_exact_duplicates": False, "remove_email_duplicates": False}
    assert deduplicate_leads(df, p, off).count() == 3
    assert deduplicate_leads(df, profile(email="unknown")).count() == 2


def brute_force_dedupe(records, email_names):
    """Survivor row ids, by the rules as stated: copies first, then column by column."""
    seen, left = set(), []
    for r in records:
        key = tuple(v for k, v in r.items() if k != "row_id")
        if key not in seen:
            seen.add(key)
            left.append(r)
    for name in email_names:
        best = {}
        for r in left:
            address = (r[name] or "").strip().lower() or ("blank", r["row_id"])
            score = sum(1 for k, v in r.items() if k != "row_id" and v and v.strip())
            if address not in best or score > best[address][0]:
                best[address] = (score, r)
        left = sorted((r for _, r in best.values()), key=lambda r: r["row_id"])
    return [r["row_id"] for r in left]


@pytest.mark.parametrize("seed", range(4))
def test_dedup_equals_brute_force_with_a_hot_key(spark, seed):
    rnd = random.Random(seed)

    def address():
        if rnd.random() < 0.4:  # one address holds a large share of all rows
            return rnd.choice(["hot@x.org", "HOT@x.org", " hot@x.org"])
        return rnd.choice([None, "", f"u{rnd.randint(0, 30)}@x.org"])

    records = [
        {"row_id": i, "e1": address(), "e2": address(), "p": rnd.choice([None, " ", "1", "2"])}
        for i in range(600)
    ]
    df = spark.createDataFrame(
        [tuple(r.values()) for r in records], "row_id BIGINT, e1 STRING, e2 STRING, p STRING"
    )
    for names in (["e1"], ["e1", "e2"]):
        wanted = brute_force_dedupe(records, names)
        p = profile(**dict.fromkeys(names, "email"))
        for parts in (1, 13):
            out = deduplicate_leads(df.repartition(parts), p)
            assert rows(out, "row_id") == wanted


def test_dedup_plan_is_one_shuffle_with_a_rank_before_it(numbered):
    df = numbered(email=["a@x.org", "b@x.org"], name=["n", "m"])
    out = deduplicate_leads(df, profile(email="email"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("WindowGroupLimit") == 2


# --- the whole plan ------------------------------------------------------------


def messy(numbered):
    return numbered(
        name=["  GRACE HOPPER", "ada king", "Ada King", "nobody here", "no mail", "ALAN TURING",
              "alan turing"],
        email=["Grace@X.org", "ada@x.org", "ADA@x.org ", "broken", None, "info@t.org", "info@t.org"],
        phone=["5550100123", None, "5550100124", "5550100125", "", "5550100126", "5550100126"],
    )


def test_process_leads_end_to_end(numbered):
    result = process_leads(messy(numbered), row_id="row_id")
    assert rows(result.clean, "row_id", "name", "first_name", "last_name", "email", "is_role_email") == [
        (0, "Grace Hopper", "Grace", "Hopper", "grace@x.org", False),
        (2, "Ada King", "Ada", "King", "ada@x.org", False),
        (5, "Alan Turing", "Alan", "Turing", "info@t.org", True),
    ]
    assert rows(result.rejected, "row_id", "rejection_reason") == [
        (3, "INVALID_EMAIL_FORMAT"), (4, "BLANK_EMAIL"),
    ]
    report = result.report()
    assert report == {
        "input_rows": 7, "output_rows": 3, "rejected_rows": 2, "semantic_types_detected": 3,
        "formatting": {"whitespace_fixes": 2, "name_fields_formatted": 6,
                       "email_fields_normalized": 2, "full_names_split": 7},
        "validation": {"total_rows": 7, "valid_rows": 5, "rejected_rows": 2,
                       "invalid_email_count": 1, "blank_email_count": 1,
                       "role_based_email_count": 2},
        "deduplication": {"input_rows": 5, "output_rows": 3, "exact_duplicates_removed": 1,
                          "email_duplicates_removed": 1, "rows_retained": 3},
    }
    json.dumps(report)
    assert result.formatted_profile.of_type("first_name") == ["first_name"]
    d = report["deduplication"]
    assert d["exact_duplicates_removed"] + d["email_duplicates_removed"] == d["input_rows"] - d["output_rows"]


def test_process_leads_matches_its_operators_one_by_one(numbered):
    from tablecare import semantic_profile

    df = messy(numbered)
    first = semantic_profile(df, row_id="row_id")
    formatted = format_leads(df, first, row_id="row_id")
    second = semantic_profile(formatted, row_id="row_id")
    split = validate_leads(formatted, second)
    kept = deduplicate_leads(split.valid, second)
    result = process_leads(df, row_id="row_id")
    assert result.profile == first and result.formatted_profile == second
    assert sorted(result.clean.collect()) == sorted(kept.collect())
    assert sorted(result.rejected.collect()) == sorted(split.rejected.collect())
    assert result.report()["validation"] == one(split.report)
    assert result.report()["formatting"] == one(format_changes(df, first, row_id="row_id"))


def test_columns_that_turn_into_emails_once_formatted(numbered):
    """A Kelvin sign becomes a plain k in lower case; a split part may hold addresses."""
    from tablecare import semantic_profile

    odd = numbered(
        email=["a@x.org", "b@x.org", "c@x.org", "\u212aim@x.org", "\u212a@y.org"],
        name=["e@x.org a", "f@x.org b", "g@x.org c", "Ada King", "Bob Roe"],
    )
    result = process_leads(odd, row_id="row_id")
    formatted = format_leads(odd, semantic_profile(odd, row_id="row_id"), row_id="row_id")
    second = semantic_profile(formatted, row_id="row_id")
    assert result.formatted_profile == second
    assert second.of_type("email") == ["email", "first_name"]
    split = validate_leads(formatted, second)
    assert sorted(result.rejected.collect()) == sorted(split.rejected.collect())
    assert result.report()["validation"] == one(split.report)
    assert rows(result.rejected, "row_id") == [3, 4]


def test_process_leads_without_a_row_id(numbered):
    given = process_leads(messy(numbered), row_id="row_id")
    own = process_leads(messy(numbered).drop("row_id").coalesce(1))
    assert own.clean.columns == [c for c in given.clean.columns if c != "row_id"]
    assert sorted(own.clean.collect()) == sorted(given.clean.drop("row_id").collect())
    assert own.report() == given.report()


@pytest.mark.parametrize("step", ["run_formatting", "run_validation", "run_deduplication"])
def test_process_leads_switches(numbered, step):
    result = process_leads(messy(numbered), {step: False}, row_id="row_id")
    report = result.report()
    section = {"run_formatting": "formatting", "run_validation": "validation",
               "run_deduplication": "deduplication"}[step]
    assert report[section] == {}
    assert all(report[s] for s in ("formatting", "validation", "deduplication") if s != section)
    if step == "run_validation":
        assert result.rejected.columns == [] and report["rejected_rows"] == 0
        # Without validation the two rows lacking a valid address stay.
        assert rows(result.clean, "row_id") == [0, 2, 3, 4, 5]
    if step == "run_deduplication":
        assert rows(result.clean, "row_id") == [0, 1, 2, 5, 6]
        assert report["output_rows"] == 5


def test_process_leads_all_off(numbered):
    off = dict.fromkeys(["run_formatting", "run_validation", "run_deduplication"], False)
    df = messy(numbered)
    result = process_leads(df, off, row_id="row_id")
    assert sorted(result.clean.collect()) == sorted(df.collect())


def test_process_leads_refuses_wrong_input(numbered):
    with pytest.raises(TypeError):
        process_leads({"a": [1]})
    with pytest.raises(ValueError):
        process_leads(messy(numbered).limit(0), row_id="row_id")
    with pytest.raises(ValueError):
        process_leads(messy(numbered).select("row_id").limit(0).withColumn("x", F.lit(1)), row_id="row_id")


def test_no_email_column_passes_all_rows(numbered):
    df = numbered(name=["Ada King", "Bob Roe", "Cy Poe", "Cy Poe"])
    result = process_leads(df, row_id="row_id")
    assert rows(result.clean, "row_id") == [0, 1, 2] and result.rejected.count() == 0


def test_outputs_on_disk(spark, numbered, tmp_path):
    result = process_leads(messy(numbered), row_id="row_id")
    write_lead_outputs(result, str(tmp_path / "out"))
    back = read_leads(spark, str(tmp_path / "out" / "crm_ready")).df
    assert sorted(r["email"] for r in back.collect()) == ["ada@x.org", "grace@x.org", "info@t.org"]
    rejected = read_leads(spark, str(tmp_path / "out" / "rejected")).df
    assert sorted(r["rejection_reason"] for r in rejected.collect()) == [
        "BLANK_EMAIL", "INVALID_EMAIL_FORMAT",
    ]
    report = spark.read.json(str(tmp_path / "out" / "report")).first()
    assert (report["input_rows"], report["output_rows"], report["rejected_rows"]) == (7, 3, 2)


def test_stream_gives_what_the_batch_gives(spark, numbered, tmp_path):
    from tablecare import semantic_profile

    df = messy(numbered)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    p = semantic_profile(df, row_id="row_id")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        check_stream(stream, p).writeStream.format("memory").queryName("arrived")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.processAllAvailable()
    query.stop()
    batch = check_stream(df, p)
    assert sorted(map(str, spark.table("arrived").collect())) == sorted(map(str, batch.collect()))


def test_email_key_is_what_the_survivors_differ_in(numbered):
    result = process_leads(messy(numbered), row_id="row_id")
    keys = result.clean.select(email_key(F.col("email")).alias("k"))
    assert keys.distinct().count() == keys.count()
