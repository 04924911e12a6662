"""Text to boolean, number and timestamp. All functions take stripped text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablecare import fixed_values as fv


def is_bool_word(text: Column, true_words=fv.TRUE_WORDS, false_words=fv.FALSE_WORDS) -> Column:
    return F.lower(text).isin(*_lower(true_words), *_lower(false_words))


def to_bool(text: Column, true_words=fv.TRUE_WORDS, false_words=fv.FALSE_WORDS) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*_lower(true_words)), True).when(
        word.isin(*_lower(false_words)), False
    )


def _lower(words):
    return [w.lower() for w in words]


def is_number(text: Column) -> Column:
    """True for decimal numbers. A bare cast would also take ``1d``, ``1f`` and hex floats."""
    return text.rlike(fv.NUMBER_PATTERN)


def to_number(text: Column) -> Column:
    """The DOUBLE a text stands for, NULL where it is not a number."""
    return F.when(is_number(text), text.try_cast("double"))


def is_whole(number: Column) -> Column:
    """True where a DOUBLE is integral and fits a BIGINT."""
    return (number == F.rint(number)) & (F.abs(number) < F.lit(9.2e18))


def to_whole(text: Column) -> Column:
    """The BIGINT a text stands for; plain digits are read exactly, without going by DOUBLE."""
    return F.when(text.rlike(fv.INTEGER_PATTERN), text.try_cast("bigint")).otherwise(
        to_number(text).try_cast("bigint")
    )


def has_offset(fmt: str) -> bool:
    return "XXX" in fmt


def to_timestamp(text: Column, fmt: str, shape: str) -> Column:
    """Parse by one format; values of another shape are NULL without trying the parser.

    Text with an offset is an instant (TIMESTAMP). Text without one is a date and time of no
    zone (TIMESTAMP_NTZ), the same wherever it is read: it is parsed as if in UTC and counted
    from 1970, so that no session's zone, with hours that are skipped or come twice, has a say.
    """
    if has_offset(fmt):
        return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
    instant = F.when(text.rlike(shape), F.try_to_timestamp(F.concat(text, F.lit(" Z")), F.lit(fmt + " XXX")))
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01").cast("timestamp_ntz"))
