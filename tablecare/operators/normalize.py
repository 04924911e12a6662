"""Formatting of lead tables: trim, title-case names, lower-case emails, split full names."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from tablecare.config import FormatConfig, settings
from tablecare.functions.columns import check_names, col, find_name
from tablecare.functions.text import first_word, one_spaced, other_words, strip, title_case
from tablecare.operators.semantic import SemanticProfile, text_columns

NAME_TYPES = ("first_name", "last_name", "full_name")


@dataclass(frozen=True)
class Formatted:
    """What formatting makes of a table; nothing is run yet.

    ``wide`` holds every version of every value side by side, each computed once
    and used by all that need it; Spark prunes the versions nobody asks for.
    """

    wide: DataFrame
    output: tuple[tuple[str, Column], ...]  # name -> column of ``wide``
    changes: dict[str, Column]  # counter name -> how many cells of a row of ``wide`` it counts
    newly_ascii: Column  # email cells of a row that lost all letters outside ASCII
    touched: tuple[str, ...]  # output columns whose words may differ from the input's

    @property
    def table(self) -> DataFrame:
        return self.wide.select(*[c.alias(n) for n, c in self.output])

    def table_with(self, **more: Column) -> DataFrame:
        """The formatted table and further columns made from ``wide``."""
        columns = [c.alias(n) for n, c in self.output]
        return self.wide.select(*columns, *[c.alias(n) for n, c in more.items()])


def plan_format(
    df: DataFrame, profile: SemanticProfile, config=None, row_id: str | None = None
) -> Formatted:
    cfg = settings(FormatConfig, config)
    check_names(df)
    texts = [n for n in text_columns(df) if n != row_id]
    names_ = [n for n in profile.of_type(*NAME_TYPES) if n in texts and cfg.title_case_names]
    emails = [n for n in profile.of_type("email") if n in texts and cfg.normalize_emails]
    trimmed = texts if cfg.trim_whitespace else []
    source = None
    if cfg.split_full_names:
        source = _split_source(df, [n for n in profile.of_type("full_name") if n in texts])

    raw, trim, done = _versions("raw"), _versions("trimmed"), _versions("formatted")
    wide = df.select(
        *[col(n).alias(raw.name(n)) for n in df.columns],
        *[strip(col(n)).alias(trim.name(n)) for n in trimmed],
    )

    def before(n):
        return trim(n) if n in trimmed else raw(n)

    wide = wide.withColumns(
        {
            **{done.name(n): title_case(before(n)) for n in names_},
            **{done.name(n): F.lower(before(n)) for n in emails},
        }
    )

    def final(n):
        return done(n) if n in names_ or n in emails else before(n)

    output, split = [], []
    for n in df.columns:
        output.append((n, final(n)))
        if n == source:
            wide = wide.withColumn("__words", one_spaced(final(n)))
            words = F.col("__words")
            output.append(("first_name", first_word(final(n), words)))
            output.append(("last_name", other_words(final(n), words)))
            split.append((F.coalesce(words, F.lit("")) != "").cast("int"))

    def differing(a, b, names):
        return [(~a(n).eqNullSafe(b(n))).cast("int") for n in names]

    counted = {
        "name_fields_formatted": differing(before, final, names_),
        "email_fields_normalized": differing(before, final, emails),
        "whitespace_fixes": differing(raw, before, trimmed),
        "full_names_split": split,
    }
    changes = {name: reduce(add, parts, F.lit(0)) for name, parts in counted.items()}
    converted = [(_is_ascii(final(n)) & ~_is_ascii(before(n))).cast("int") for n in emails]
    newly_ascii = reduce(add, [F.coalesce(c, F.lit(0)) for c in converted], F.lit(0))
    touched = [*names_, *emails, *(("first_name", "last_name") if source else ())]
    return Formatted(wide, tuple(output), changes, newly_ascii, tuple(touched))


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


class _versions:
    """Names and columns of one version of the table's values."""

    def __init__(self, label: str):
        self.label = label

    def name(self, n: str) -> str:
        return f"__{self.label}_{n}"

    def __call__(self, n: str) -> Column:
        return col(self.name(n))


def _split_source(df: DataFrame, full_names: list[str]) -> str | None:
    """The column to split: the first full name, unless a target column exists already."""
    taken = find_name(df.columns, "first_name") or find_name(df.columns, "last_name")
    return full_names[0] if full_names and not taken else None


def format_leads(
    df: DataFrame, profile: SemanticProfile, config=None, row_id: str | None = None
) -> DataFrame:
    """The formatted table. Row by row, so it works on streams too."""
    return plan_format(df, profile, config, row_id).table


def format_changes(
    df: DataFrame, profile: SemanticProfile, config=None, row_id: str | None = None
) -> DataFrame:
    """One row: how many cells each formatting step changed, and how many names were split."""
    plan = plan_format(df, profile, config, row_id)
    cells = plan.wide.select(*[c.alias(n) for n, c in plan.changes.items()])
    return cells.groupBy().agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in plan.changes])
