"""Settings, one frozen dataclass per stage.

Every stage takes its dataclass, or a plain dict of overrides that is merged
over the defaults, so a partial dict never switches anything else off.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from tablecare import fixed_values as fv


def settings(cls, overrides=None):
    """Return ``overrides`` as an instance of ``cls`` (None, a dict, or one already)."""
    if overrides is None:
        return cls()
    if isinstance(overrides, cls):
        return overrides
    known = {f.name for f in fields(cls)}
    stray = set(overrides) - known
    if stray:
        raise ValueError(f"unknown {cls.__name__} settings: {sorted(stray)}")
    return cls(**overrides)


@dataclass(frozen=True)
class SemanticConfig:
    min_non_null_for_detection: int = fv.MIN_VALUES
    confidence_threshold: float = fv.CONFIDENCE_THRESHOLD
    header_boost: float = fv.HEADER_BOOST


@dataclass(frozen=True)
class FormatConfig:
    split_full_names: bool = True
    normalize_emails: bool = True
    title_case_names: bool = True
    trim_whitespace: bool = True


@dataclass(frozen=True)
class ValidationConfig:
    reject_blank_emails: bool = True
    flag_role_accounts: bool = True
    strict_email_validation: bool = True


@dataclass(frozen=True)
class DedupConfig:
    remove_exact_duplicates: bool = True
    remove_email_duplicates: bool = True


@dataclass(frozen=True)
class LeadConfig:
    run_formatting: bool = True
    run_validation: bool = True
    run_deduplication: bool = True
    semantic: SemanticConfig | dict | None = None
    formatting: FormatConfig | dict | None = None
    validation: ValidationConfig | dict | None = None
    deduplication: DedupConfig | dict | None = None


@dataclass(frozen=True)
class QualityConfig:
    null_warning_threshold: float = fv.NULL_WARNING_PCT
    null_critical_threshold: float = fv.NULL_CRITICAL_PCT
    high_cardinality_min_unique: int = fv.HIGH_CARDINALITY_MIN_UNIQUE
    enable_outlier_checks: bool = True
    outlier_iqr_factor: float = fv.IQR_FACTOR


@dataclass(frozen=True)
class FilterConfig:
    null_drop_threshold: float = fv.NULL_DROP_RATIO
    drop_single_value_columns: bool = True
    single_value_min_rows: int = fv.SINGLE_VALUE_MIN_ROWS
    force_drop_columns: tuple = ()


@dataclass(frozen=True)
class MissingConfig:
    numeric_strategy: str = "median"  # mean | median | constant | drop_rows | flag
    categorical_strategy: str = "mode"  # mode | constant | drop_rows | flag
    datetime_strategy: str = "drop_rows"  # drop_rows | flag
    numeric_fill_value: float = 0
    categorical_fill_value: str = fv.CATEGORICAL_FILL
    impute_max_null_ratio: float = fv.IMPUTE_MAX_NULL_RATIO


@dataclass(frozen=True)
class CoercionConfig:
    coerce_to_bool: bool = True
    coerce_to_numeric: bool = True
    coerce_to_datetime: bool = True
    bool_true_values: tuple = fv.TRUE_WORDS
    bool_false_values: tuple = fv.FALSE_WORDS
    numeric_cast_success_threshold: float = fv.NUMBER_RATE
    datetime_cast_success_threshold: float = fv.TIMESTAMP_RATE
    datetime_formats: tuple = field(default=fv.TIMESTAMP_FORMATS)


@dataclass(frozen=True)
class ReportConfig:
    show_cleaning_summary: bool = True


@dataclass(frozen=True)
class AuditConfig:
    skip_clean: bool = False
    quality: QualityConfig | dict | None = None
    filter: FilterConfig | dict | None = None
    missing: MissingConfig | dict | None = None
    coercion: CoercionConfig | dict | None = None
    report: ReportConfig | dict | None = None
