"""Text normalisers: strip, blank test, title case, name split.

All of them are plain scalar functions (no lambdas over arrays), so a select
made of them stays inside one generated-code stage.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tablecare import fixed_values as fv
from tablecare.functions.columns import family

WHITESPACE_CLASS = "[" + fv.WHITESPACE + "]"

# The first apostrophe of a name part (a run without space or hyphen) of three
# letters or more.
_FIRST_APOSTROPHE = r"(?<![^ \-])(?=[^ \-]{3})([^ '\-]*')"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included."""
    return F.btrim(c, F.lit(fv.WHITESPACE))


def one_spaced(c: Column) -> Column:
    """Strip, and turn every inner run of whitespace into one space."""
    return F.regexp_replace(strip(c), WHITESPACE_CLASS + "+", " ")


def is_blank(c: Column, dtype: T.DataType | None = None) -> Column:
    """True for NULL, NaN and text made of whitespace only."""
    if dtype is None or family(dtype) == "string":
        return c.isNull() | (F.ltrim(c, F.lit(fv.WHITESPACE)) == "")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def title_case(c: Column) -> Column:
    """Capitalise every word, every hyphenated part, and what follows an apostrophe.

    ``initcap`` capitalises after spaces only. One-spaced text never holds two
    spaces in a row, so a double space marks the other places to capitalise and
    is taken out again afterwards.
    """
    marked = F.replace(one_spaced(c), F.lit("-"), F.lit("-  "))
    marked = F.regexp_replace(marked, _FIRST_APOSTROPHE, "$1  ")
    return F.replace(F.initcap(marked), F.lit("  "), F.lit(""))


def first_word(c: Column, words: Column | None = None) -> Column:
    """The first word; NULL and blank values come back as they are. ``words`` is the one-spaced
    form of ``c`` where the table has it at hand."""
    words = one_spaced(c) if words is None else words
    return F.when(words != "", F.substring_index(words, " ", 1)).otherwise(c)


def other_words(c: Column, words: Column | None = None) -> Column:
    """All words but the first, joined by spaces; NULL and blank come back as they are."""
    words = one_spaced(c) if words is None else words
    cut = F.instr(words, " ")
    rest = F.when(cut > 0, F.substr(words, cut + 1)).otherwise("")
    return F.when(words != "", rest).otherwise(c)
