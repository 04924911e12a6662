"""Email rules: validity, reason for rejection, role accounts, comparison key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablecare import fixed_values as fv
from tablecare.functions.text import strip


def is_valid_email(text: Column) -> Column:
    """For stripped text. The pattern admits no whitespace inside, so one match settles it."""
    return text.rlike(fv.EMAIL_PATTERN)


def invalid_reason(text: Column) -> Column:
    """Why a stripped value is not a usable address; meaningful for invalid values only."""
    at = F.instr(text, "@")
    domain = F.substr(text, at + 1)
    bad_domain = (at > 0) & (
        ~domain.contains(".") | domain.startswith(".") | domain.endswith(".")
    )
    return (
        F.when(text.isNull() | (text == ""), fv.BLANK_EMAIL)
        .when(bad_domain, fv.INVALID_DOMAIN)
        .otherwise(fv.INVALID_EMAIL_FORMAT)
    )


def is_role_email(text: Column) -> Column:
    """For stripped text: the part before the first ``@`` is a shared mailbox such as info."""
    return F.lower(F.substring_index(text, "@", 1)).isin(*fv.ROLE_PREFIXES)


def email_key(c: Column) -> Column:
    """The form in which two addresses count as the same; NULL for blank values."""
    key = F.lower(strip(c.cast("string")))
    return F.when(key != "", key)
