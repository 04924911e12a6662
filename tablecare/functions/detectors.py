"""Predicates that tell what a text value is.

Each takes a text column and is TRUE where the value fits. Every pattern is one
pass over the value without backtracking traps (patterns that repeat a group
look at short values only), and none uses array lambdas, so all of them compile
into the surrounding generated code.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from tablecare import fixed_values as fv
from tablecare.functions.text import WHITESPACE_CLASS, strip

_SPACING = r"[+\-()." + fv.WHITESPACE + "]*"
_PHONE = r"^(?:\+%s|(?=\p{Nd}))(?:\p{Nd}%s){%d,%d}$" % (_SPACING, _SPACING, *fv.PHONE_DIGITS)
_FULL_NAME = "^{t}(?:{ws}+{t}){{{lo},{hi}}}$".format(
    t=fv.NAME_TOKEN,
    ws=WHITESPACE_CLASS,
    lo=fv.FULL_NAME_TOKENS[0] - 1,
    hi=fv.FULL_NAME_TOKENS[1] - 1,
)
_SINGLE_NAME = f"^{fv.NAME_TOKEN}$"


# Each test looks at a value that is stripped already, and at its lower-case form, so that a
# table can prepare both once for all tests. Comparing first bytes or looking for one character
# costs next to nothing and spares most values the pattern.


def _email(text: Column, lower: Column) -> Column:
    return text.contains("@") & text.rlike(fv.EMAIL_PATTERN)


def _phone(text: Column, lower: Column) -> Column:
    return ((text < ":") | (text > "~")) & text.rlike(_PHONE)


def _letters_first(text: Column) -> Column:
    return (text >= "A") & (text < "{") & ~text.contains("@")


def _url(text: Column, lower: Column) -> Column:
    web = lower.startswith("http://") | lower.startswith("https://")
    bare = lower.startswith("www.")
    return (web & lower.contains(".")) | (bare & F.substring(lower, 5, 2**31 - 1).contains("."))


def _linkedin(text: Column, lower: Column) -> Column:
    return lower.contains("linkedin.com") & _url(text, lower)


def _company(text: Column, lower: Column) -> Column:
    return reduce(or_, [lower.endswith(suffix) for suffix in fv.COMPANY_SUFFIXES])


def _full_name(text: Column, lower: Column) -> Column:
    sized = _letters_first(text) & F.length(text).between(*fv.FULL_NAME_LENGTH)
    return F.when(sized, text.rlike(_FULL_NAME) & ~_company(text, lower)).otherwise(False)


def _single_name(text: Column, lower: Column) -> Column:
    sized = _letters_first(text) & F.length(text).between(*fv.SINGLE_NAME_LENGTH)
    return F.when(sized, text.rlike(_SINGLE_NAME)).otherwise(False)


# The tests in order of preference when two fit a column equally well. A single
# name stands for first or last name, whichever the header suggests.
TESTS = {
    "linkedin_profile": _linkedin,
    "email": _email,
    "phone_number": _phone,
    "url": _url,
    "full_name": _full_name,
    "single_name": _single_name,
    "company_name": _company,
}


def _on_raw(test):
    def detect(c: Column) -> Column:
        return test(strip(c), F.lower(strip(c)))

    return detect


is_linkedin = _on_raw(_linkedin)
is_email = _on_raw(_email)
is_phone = _on_raw(_phone)  # first a digit or +; 7 to 15 digits once separators are gone
is_url = _on_raw(_url)
is_full_name = _on_raw(_full_name)
is_single_name = _on_raw(_single_name)
is_company = _on_raw(_company)  # ends with a legal suffix; no word boundary is asked for

DETECTORS = {name: _on_raw(test) for name, test in TESTS.items()}
