import pytest

from tablecare import semantic_profile
from tablecare.config import SemanticConfig
from tablecare.operators.semantic import SemanticProfile


def meaning(table, values, column="col", **config):
    return semantic_profile(table(**{column: values}), config or None).columns[column]


PEOPLE = ["Ada Lovelace", "Grace Hopper", "Anne-Marie O'Hara", "Alan Mathison Turing"]
FIRMS = ["Acme Inc", "Foo GmbH", "Bar Ltd", "Baz LLC"]


@pytest.mark.parametrize(
    "values, wanted",
    [
        ([f"user{i}@example.com" for i in range(10)], "email"),
        (["+44 20 7946 0958", "5551234567", "1-800-555-0199", "919876543210"], "phone_number"),
        (PEOPLE, "full_name"),
        (FIRMS, "company_name"),
        (["https://a.com", "http://b.org/x", "www.c.net"], "url"),
        (["https://linkedin.com/in/a", "https://www.linkedin.com/in/b", "www.linkedin.com/c"],
         "linkedin_profile"),
        (["red", "green", "blue"], "first_name"),
        (PEOPLE[:2] + FIRMS[:2], "unknown"),
        (["Ada Lovelace", "a@b.co", "5551234567", "https://a.com", "??"], "unknown"),
    ],
)
def test_type_by_values(table, values, wanted):
    assert meaning(table, values).semantic_type == wanted


def test_leading_bracket_costs_one_phone(table):
    found = meaning(table, ["(555) 123-4567", "555-123-4567", "5551234567", "1234567", "12345678"])
    assert (found.semantic_type, found.match_count, found.confidence) == ("phone_number", 4, 0.8)


def test_header_lifts_and_picks_the_single_name(table):
    half = ["a@b.co", "c@d.org", "n/a", "?", "-"]
    assert meaning(table, half).semantic_type == "unknown"
    lifted = meaning(table, half, "Email Address")
    assert (lifted.semantic_type, lifted.confidence, lifted.header_matched) == ("email", 0.6, True)
    assert lifted.reason == "2/5 sampled values matched email pattern; header boost applied"
    assert meaning(table, ["Roe", "Doe", "Poe"], " Surname ").semantic_type == "last_name"
    assert meaning(table, half, "email", confidence_threshold=0.9).semantic_type == "unknown"


def test_highest_confidence_beats_order_and_order_breaks_ties(table):
    pages = [f"https://example.com/{i}" for i in range(9)] + ["https://linkedin.com/in/x"]
    assert meaning(table, pages).semantic_type == "url"
    assert meaning(table, ["https://linkedin.com/in/x"] * 4).semantic_type == "linkedin_profile"


def test_too_few_values(table):
    found = meaning(table, ["a@b.co", "c@d.org", None, "  "], "email")
    assert (found.semantic_type, found.confidence, found.sample_size) == ("unknown", 0.0, 2)
    assert "below minimum threshold of 3" in found.reason
    assert meaning(table, [None, None, None]).sample_size == 0


def test_unknown_keeps_the_best_candidate(table):
    found = meaning(table, ["Ada Lovelace", "Grace Hopper", "1", "2", "3"], "name")
    # 2/5 plus the header boost reaches the threshold; without the header it does not.
    assert found.semantic_type == "full_name"
    found = meaning(table, ["Ada Lovelace", "Grace Hopper", "1", "2", "3"])
    assert (found.semantic_type, found.match_count, found.confidence) == ("unknown", 2, 0.4)
    assert found.detector == "none" and "0.60" in found.reason


def test_other_dtypes_are_skipped(table, spark):
    df = table("n INT, ok BOOLEAN, email STRING", n=[1, 2, 3], ok=[True, False, None],
               email=["a@b.co", "c@d.org", "e@f.net"])
    profile = semantic_profile(df)
    assert profile.columns["n"].reason == "column dtype is int; skipped semantic detection"
    assert profile.summary == {"unknown": ["n", "ok"], "email": ["email"]}
    assert profile.types_detected == 1
    rows = {r["column"]: r["semantic_type"] for r in profile.to_df(spark).collect()}
    assert rows == {"n": "unknown", "ok": "unknown", "email": "email"}
    summary = {r["semantic_type"]: r["columns"] for r in profile.summary_df(spark).collect()}
    assert summary == {"unknown": ["n", "ok"], "email": ["email"]}


def test_all_values_count(table, spark):
    df = spark.range(1000).selectExpr(
        "id AS row_id", "CASE WHEN id < 700 THEN concat('u', id, '@x.org') ELSE '?' END AS c"
    )
    full = semantic_profile(df, row_id="row_id").columns["c"]
    assert (full.sample_size, full.match_count, full.confidence) == (1000, 700, 0.7)


def test_odd_column_names_and_ambiguous_ones(table):
    df = table(**{"my.e mail`s": ["a@b.co", "c@d.org", "e@f.net"]})
    assert semantic_profile(df).columns["my.e mail`s"].semantic_type == "email"
    with pytest.raises(ValueError):
        semantic_profile(table(First=["a"], first=["b"]))


def test_profile_stated_by_hand():
    assert SemanticProfile.of({"a": "email", "b": "url"}).of_type("email") == ["a"]
