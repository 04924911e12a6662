"""Where queries register, and the SQL pieces their checks share."""

from __future__ import annotations

from catalog.views import VIEWS
from tablecare import fixed_values as fv

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, views: tuple = ()):
    """Register a query, with the SQL that must give the same rows. ``views`` named here are
    put in front of the SQL as common table expressions."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ctes = [f"{v} AS ({VIEWS[v][0]})" for v in views]
            body = sql.strip()
            if ctes and body.startswith("WITH "):
                ORACLES[name] = "WITH " + ", ".join(ctes) + ", " + body[5:]
            elif ctes:
                ORACLES[name] = "WITH " + ", ".join(ctes) + " " + body
            else:
                ORACLES[name] = body
        return function

    return register


def strip(x: str) -> str:
    return f"trim({x}, '{fv.WHITESPACE}')"


WS = "[" + fv.WHITESPACE + "]"


def words(x: str) -> str:
    """The whitespace-separated words of ``x`` as a list."""
    return f"string_split_regex({strip(x)}, '{WS}+')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def is_email(x: str) -> str:
    return f"regexp_matches({strip(x)}, '{fv.EMAIL_PATTERN}')"


def is_phone(x: str) -> str:
    digits = f"regexp_replace({strip(x)}, '[+\\-().{fv.WHITESPACE}]', '', 'g')"
    return (
        f"(regexp_matches({strip(x)}, '^[+\\p{{Nd}}]') "
        f"AND regexp_matches({digits}, '^\\p{{Nd}}{{7,15}}$'))"
    )


def is_url(x: str) -> str:
    t = f"lower({strip(x)})"
    return (
        f"(((starts_with({t}, 'http://') OR starts_with({t}, 'https://')) AND contains({t}, '.')) "
        f"OR (starts_with({t}, 'www.') AND contains(substr({t}, 5), '.')))"
    )


def is_linkedin(x: str) -> str:
    return f"({is_url(x)} AND contains(lower({x}), 'linkedin.com'))"


def is_company(x: str) -> str:
    t = f"lower({strip(x)})"
    return "(" + " OR ".join(f"ends_with({t}, '{s}')" for s in fv.COMPANY_SUFFIXES) + ")"


_TOKEN = "^" + fv.NAME_TOKEN.replace("'", "''") + "$"


def is_full_name(x: str) -> str:
    good = f"len(list_filter({words(x)}, lambda w: regexp_matches(w, '{_TOKEN}')))"
    return (
        f"(length({strip(x)}) BETWEEN 3 AND 60 AND NOT {is_company(x)} "
        f"AND len({words(x)}) BETWEEN 2 AND 4 AND {good} = len({words(x)}))"
    )


def is_single_name(x: str) -> str:
    return f"(length({strip(x)}) BETWEEN 2 AND 20 AND regexp_matches({strip(x)}, '{_TOKEN}'))"


DETECTOR_SQL = {
    "linkedin_profile": is_linkedin,
    "email": is_email,
    "phone_number": is_phone,
    "url": is_url,
    "full_name": is_full_name,
    "single_name": is_single_name,
    "company_name": is_company,
}


def title(x: str) -> str:
    """Title case by lists: words, hyphenated parts, both sides of the first apostrophe."""

    def cap(s):
        return f"upper(substr({s}, 1, 1)) || lower(substr({s}, 2))"

    cut = "instr(p, '''')"
    part = (
        f"CASE WHEN {cut} > 0 AND length(p) > 2 "
        f"THEN {cap(f'substr(p, 1, {cut})')} || {cap(f'substr(p, {cut} + 1)')} ELSE {cap('p')} END"
    )
    word = f"array_to_string(list_transform(string_split(w, '-'), lambda p: {part}), '-')"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL "
        f"ELSE array_to_string(list_transform({words(x)}, lambda w: {word}), ' ') END"
    )


def first_word(x: str) -> str:
    return f"CASE WHEN {blank(x)} THEN {x} ELSE {words(x)}[1] END"


def other_words(x: str) -> str:
    return f"CASE WHEN {blank(x)} THEN {x} ELSE array_to_string({words(x)}[2:], ' ') END"


def reason(x: str) -> str:
    domain = f"substr({strip(x)}, instr({strip(x)}, '@') + 1)"
    return (
        f"CASE WHEN {blank(x)} THEN 'BLANK_EMAIL' WHEN {is_email(x)} THEN NULL "
        f"WHEN contains({x}, '@') AND (NOT contains({domain}, '.') OR starts_with({domain}, '.') "
        f"OR ends_with({domain}, '.')) THEN 'INVALID_DOMAIN' ELSE 'INVALID_EMAIL_FORMAT' END"
    )


def is_role(x: str) -> str:
    listed = ", ".join(f"'{p}'" for p in fv.ROLE_PREFIXES)
    return f"coalesce(split_part(lower({strip(x)}), '@', 1) IN ({listed}), false)"


def score(*columns: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {blank(c)} THEN 0 ELSE 1 END" for c in columns) + ")"
