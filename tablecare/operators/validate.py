"""Row validation: split leads into valid ones and rejected ones with a reason."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from tablecare import fixed_values as fv
from tablecare.config import ValidationConfig, settings
from tablecare.functions.columns import col
from tablecare.functions.emails import invalid_reason, is_role_email, is_valid_email
from tablecare.functions.text import strip
from tablecare.operators.semantic import SemanticProfile

REASON = "rejection_reason"
ROLE_FLAG = "is_role_email"
ROLE_CELLS = "__role_cells"


@dataclass(frozen=True)
class LeadSplit:
    valid: DataFrame
    rejected: DataFrame
    report: DataFrame  # one row of counts; lazy like the other two


def email_columns(df: DataFrame, profile: SemanticProfile) -> list[str]:
    return [n for n in profile.of_type("email") if n in df.columns]


def check_leads(
    df: DataFrame, names: list[str], config=None, count_cells: bool = False
) -> DataFrame:
    """``df`` with the rejection reason (NULL for valid rows) and the role flag of every row.

    The first failing column gives the reason. The flag looks at every column that
    is filled and, when formats are checked, valid, on rejected rows too.
    ``count_cells`` adds how many such role addresses the row has. Row by row, so
    it works on streams too.
    """
    cfg = settings(ValidationConfig, config)
    if not names:
        none = {REASON: F.lit(None).cast("string"), ROLE_FLAG: F.lit(False)}
        return df.withColumns({**none, **({ROLE_CELLS: F.lit(0)} if count_cells else {})})

    texts = {n: f"__text{i}" for i, n in enumerate(names)}
    valid = {n: f"__valid{i}" for i, n in enumerate(names)}
    roles = {n: f"__role{i}" for i, n in enumerate(names)}
    # Each step is a column of its own, so that it is computed once for all that use it.
    df = df.withColumns({texts[n]: strip(col(n).cast("string")) for n in names})
    df = df.withColumns(
        {valid[n]: _passes(F.col(texts[n]), cfg) for n in names}
    )
    df = df.withColumns(
        {
            roles[n]: F.coalesce(F.col(valid[n]) & is_role_email(F.col(texts[n])), F.lit(False))
            for n in names
        }
    )
    out = {
        REASON: F.coalesce(*[_reason(F.col(texts[n]), F.col(valid[n]), cfg) for n in names]),
        ROLE_FLAG: reduce(or_, [F.col(roles[n]) for n in names]),
    }
    if count_cells:
        out[ROLE_CELLS] = reduce(add, [F.col(roles[n]).cast("int") for n in names])
    return df.withColumns(out).drop(*texts.values(), *valid.values(), *roles.values())


def _passes(text: Column, cfg: ValidationConfig) -> Column:
    """Filled and, when formats are checked, valid."""
    filled = text.isNotNull() & (text != "")
    return filled & is_valid_email(text) if cfg.strict_email_validation else filled


def _reason(text: Column, valid: Column, cfg: ValidationConfig) -> Column:
    blank = F.lit(fv.BLANK_EMAIL if cfg.reject_blank_emails else None)
    reason = F.when(valid, F.lit(None)).when(text.isNull() | (text == ""), blank)
    return reason.otherwise(invalid_reason(text)).cast("string")


def validation_counters(cfg: ValidationConfig) -> dict[str, Column]:
    """Aggregates of the validation report over ``check_leads(..., count_cells=True)``. Rows
    count once, role addresses once per cell."""
    reason = F.col(REASON)
    cells = F.coalesce(F.sum(ROLE_CELLS), F.lit(0)) if cfg.flag_role_accounts else F.lit(0)
    return {
        "total_rows": F.count("*"),
        "valid_rows": F.count_if(reason.isNull()),
        "rejected_rows": F.count(reason),
        "invalid_email_count": F.count_if(
            reason.isin(fv.INVALID_DOMAIN, fv.INVALID_EMAIL_FORMAT)
        ),
        "blank_email_count": F.count_if(reason == fv.BLANK_EMAIL),
        "role_based_email_count": cells.cast("bigint"),
    }


def validation_report(df: DataFrame, names: list[str], config=None) -> DataFrame:
    """One row of counts."""
    cfg = settings(ValidationConfig, config)
    checked = check_leads(df, names, cfg, count_cells=True)
    return checked.groupBy().agg(*[c.alias(n) for n, c in validation_counters(cfg).items()])


def _keeps(text: Column, cfg: ValidationConfig) -> Column:
    """Whether a cell lets its row pass: one pattern at most, never NULL."""
    if cfg.strict_email_validation:
        passes = is_valid_email(text)
        return F.coalesce(passes, F.lit(False)) if cfg.reject_blank_emails else F.coalesce(
            (text == "") | passes, F.lit(True)
        )
    return F.coalesce(text != "", F.lit(False)) if cfg.reject_blank_emails else F.lit(True)


def validate_leads(df: DataFrame, profile: SemanticProfile, config=None) -> LeadSplit:
    """Split ``df`` by the email columns of ``profile``. Lazy: nothing is run.

    Spark moves a filter below the columns computed before it and computes them there
    again, so the split asks the shortest question that decides, not for the reason.
    """
    cfg = settings(ValidationConfig, config)
    names = email_columns(df, profile)
    texts = [f"__text{i}" for i in range(len(names))]
    texted = df.withColumns({t: strip(col(n).cast("string")) for t, n in zip(texts, names)})
    passes = reduce(and_, [_keeps(F.col(t), cfg) for t in texts], F.lit(True))
    valid = texted.filter(passes)
    if cfg.flag_role_accounts:
        # A cell of a valid row is blank or passes the format check.
        roles = [F.coalesce(is_role_email(F.col(t)), F.lit(False)) for t in texts]
        valid = valid.withColumn(ROLE_FLAG, reduce(or_, roles, F.lit(False)))
    rejected = texted.filter(~passes)
    reasons = [_reason(F.col(t), _passes(F.col(t), cfg), cfg) for t in texts]
    rejected = rejected.withColumn(REASON, F.coalesce(*reasons, F.lit(None).cast("string")))
    return LeadSplit(valid.drop(*texts), rejected.drop(*texts), validation_report(df, names, cfg))
