"""Scalar functions against stated values and against plain Python on generated text."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablecare import fixed_values as fv
from tablecare.functions import detectors, emails, parsing, text


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("GRACE HOPPER", "Grace Hopper"),
        ("ada lovelace", "Ada Lovelace"),
        ("aLaN  mATHISON\tturing", "Alan Mathison Turing"),
        ("anne-marie o'hara", "Anne-Marie O'Hara"),
        ("d'arcy", "D'Arcy"),
        ("o'", "O'"),
        ("'tis", "'Tis"),
        ("x'y'z", "X'Y'z"),
        ("a--b", "A--B"),
        ("-jo-", "-Jo-"),
        ("abc' def", "Abc' Def"),
        ("mcallister", "Mcallister"),
        ("ÉLODIE ünal", "Élodie Ünal"),
        ("Jane Roe", "Jane Roe"),
        ("   ", ""),
        (None, None),
    ],
)
def test_title_case(spark, raw, wanted):
    assert apply(spark, text.title_case, [raw]) == [wanted]


def python_title(value):
    def part(p):
        cut = p.find("'") + 1 if "'" in p and len(p) > 2 else 0
        return p[:cut].capitalize() + p[cut:].capitalize()

    return " ".join("-".join(map(part, w.split("-"))) for w in value.split())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abCD'- \t  '", max_size=14), min_size=20, max_size=60))
def test_title_case_and_split_like_python(spark, values):
    assert apply(spark, text.title_case, values) == [python_title(v) for v in values]
    assert apply(spark, text.strip, values) == [v.strip() for v in values]
    assert apply(spark, text.first_word, values) == [
        v.split()[0] if v.strip() else v for v in values
    ]
    assert apply(spark, text.other_words, values) == [
        " ".join(v.split()[1:]) if v.strip() else v for v in values
    ]


def test_strip_knows_every_python_whitespace(spark):
    spaces = [chr(i) for i in range(0x10000) if chr(i).isspace()]
    assert sorted(spaces) == sorted(fv.WHITESPACE)
    assert apply(spark, text.strip, [f"{s}x y{s}" for s in spaces]) == ["x y"] * len(spaces)
    assert apply(spark, text.one_spaced, [f"a{s}{s}b" for s in spaces]) == ["a b"] * len(spaces)


def test_is_blank(spark):
    assert apply(spark, text.is_blank, [None, "", " \t", " ", "x", "0"]) == [
        True, True, True, True, False, False,
    ]


CASES = {
    "email": (
        ["kim@example.com", " a.b+c@sub.domain.org ", "x_y%z@d-e.co", "A@B.IO"],
        ["kim@", "@example.com", "kim@localhost", "kim at example.com", "k@e.c", "a@b@c.com", "",
         "k im@example.com"],
    ),
    "phone_number": (
        ["+44 20 7946 0958", "555-123-4567", "1 (555) 123.4567", "1234567", "١٢٣٤٥٦٧"],
        ["(555) 123-4567", "123456", "1234567890123456", "555-CALL-NOW", "++", "", "-5551234567"],
    ),
    "url": (
        ["http://a.b", "HTTPS://Example.com/x", "www.site.org", " https://x.y "],
        ["http://localhost", "www.site", "ftp://a.b", "example.com", "see http://a.b"],
    ),
    "linkedin_profile": (
        ["https://www.linkedin.com/in/someone", "www.LinkedIn.com/company/x"],
        ["linkedin.com/in/someone", "https://example.com"],
    ),
    "full_name": (
        ["Ada Lovelace", "Anne-Marie O'Hara", "Juan Carlos de Borbon", " Li  Wu "],
        ["Ada", "Acme Widgets Inc", "a b c d e", "R2 D2", "Ada Lovelace-", "x" * 61 + " y", "I"],
    ),
    "single_name": (["Ada", "Anne-Marie", "O'Hara", "li"], ["A", "Ada Lovelace", "x" * 21, "A1"]),
    "company_name": (
        ["Acme Inc", "Foo GmbH", "Bar Pvt. Ltd.", "Baz Co.", "parag", "Q S.A.", "ACME LLC "],
        ["Acme", "Inc Magazine", "Company"],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_detectors(spark, name):
    good, bad = CASES[name]
    detector = detectors.DETECTORS[name]
    assert apply(spark, detector, good) == [True] * len(good)
    assert apply(spark, detector, bad) == [False] * len(bad)


def test_detectors_survive_very_long_text(spark):
    long = ["a-" * 200_000 + "b", "1" * 300_000 + "x", "a." * 200_000, "x@" + "a." * 100_000]
    for detector in detectors.DETECTORS.values():
        assert not any(apply(spark, detector, long))
    assert not any(apply(spark, parsing.is_number, long))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="+-(). 0123456789a ", max_size=20), min_size=20, max_size=60))
def test_phone_like_python(spark, values):
    def python_phone(v):
        v = v.strip()
        bare = re.sub(r"[+\-().\s]", "", v)
        return bool(v) and (v[0].isdigit() or v[0] == "+") and bare.isdigit() and 7 <= len(bare) <= 15

    assert apply(spark, detectors.is_phone, values) == [python_phone(v) for v in values]


def test_invalid_reason(spark):
    values = ["pat@", "pat@localhost", "pat@.com", "pat@domain.", "no-at-sign", "", None, "@", "a@b@c.d",
              "p t@x.yy"]
    assert apply(spark, emails.invalid_reason, values) == [
        fv.INVALID_DOMAIN, fv.INVALID_DOMAIN, fv.INVALID_DOMAIN, fv.INVALID_DOMAIN,
        fv.INVALID_EMAIL_FORMAT, fv.BLANK_EMAIL, fv.BLANK_EMAIL, fv.INVALID_DOMAIN,
        fv.INVALID_EMAIL_FORMAT, fv.INVALID_EMAIL_FORMAT,
    ]


def test_role_and_key(spark):
    values = [f"{p.upper()}@x.yy" for p in fv.ROLE_PREFIXES] + ["infos@x.yy", "my.info@x.yy", "info"]
    n = len(fv.ROLE_PREFIXES)
    assert apply(spark, emails.is_role_email, values) == [True] * n + [False, False, True]
    assert apply(spark, emails.email_key, [" A@B.c ", "", " ", None]) == ["a@b.c", None, None, None]


def test_numbers(spark):
    good = ["1", " -2.5 ", "+.5", "3.", "1e5", "1E-3", "inf", "-Infinity"]
    bad = ["1d", "2f", "0x1p3", "1,000", "1_000", "nan", "", "1 2", "e5", "--1", "true"]
    def number(c):
        return parsing.to_number(text.strip(c))

    assert all(v is not None for v in apply(spark, number, good))
    assert apply(spark, number, bad) == [None] * len(bad)
    whole = apply(spark, lambda c: parsing.is_whole(number(c)), ["7", "7.0", "7.5", "inf", "1e300", "x"])
    assert whole == [True, True, False, False, False, None]
    assert apply(spark, parsing.to_whole, ["9007199254740993", "7.0", "x", None]) == [
        9007199254740993, 7, None, None,
    ]


def test_bool_words(spark):
    assert apply(spark, parsing.to_bool, ["Yes", "n", "1", "0", "TRUE", "maybe", None]) == [
        True, False, True, False, True, None, None,
    ]


def test_every_timestamp_format_reads_what_it_writes(spark):
    moments = ["2024-03-05 07:08:09.123456", "2023-11-25 17:00:00", "2024-12-31 23:59:59"]
    for fmt, shape in fv.TIMESTAMP_FORMATS:
        written = fmt.replace("[.SSSSSS][.SSS]", ".SSSSSS")
        df = spark.createDataFrame([(m,) for m in moments], "m STRING").select(
            F.date_format(F.to_timestamp("m"), written).alias("v")
        )
        back = df.select("v", parsing.to_timestamp(F.col("v"), fmt, shape).alias("t"))
        again = back.select("v", F.date_format("t", written).alias("w")).collect()
        assert all(r["v"] == r["w"] for r in again), (fmt, again)
