"""From a messy contact table to clean leads, rejected rows and a report.

Two aggregate jobs decide what to do: one over all text columns (what they mean,
how many cells need trimming) and one over the name and email columns only (what
formatting changes, what validation counts). Clean and rejected rows are lazy:
writing them is one scan each, plus one shuffle per email column for the clean
ones. Counts come from aggregates, never from accumulators, which a re-run stage
would add twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablecare.config import (
    DedupConfig, FormatConfig, LeadConfig, SemanticConfig, ValidationConfig, settings,
)
from tablecare.functions.columns import col
from tablecare.functions.detectors import TESTS
from tablecare.functions.text import strip
from tablecare.operators import dedupe, normalize, semantic, validate
from tablecare.operators.semantic import SemanticProfile
from tablecare.sources.csv import LoadedCsv
from tablecare.sources.staging import stage, with_row_id

GIVEN_ROW_ID = "__row_id"


@dataclass
class LeadResult:
    spark: SparkSession
    clean: DataFrame
    rejected: DataFrame
    profile: SemanticProfile  # of the input
    counts: dict
    _look: "_Look" = field(repr=False, default=None)
    _split: Callable[[DataFrame], "_Rows"] = field(repr=False, default=None)
    _dedup: DedupConfig | None = None
    _row_id: str = "row_id"
    _report: dict | None = None

    @property
    def formatted_profile(self) -> SemanticProfile:
        """What the columns mean after formatting; judging them costs a job, on first use."""
        return self._look.judged()

    @cached_property
    def settled(self) -> "_Rows":
        """Valid, rejected and clean rows, all from one staged copy of the formatted table, the
        clean ones staged too: counting and writing them formats and deduplicates once."""
        rows = self._split(stage(self._look.table, "formatted"))
        return replace(rows, kept=stage(rows.kept, "clean") if self._dedup else rows.kept)

    def report(self) -> dict:
        """All counts. Only those of deduplication still cost jobs, on first use."""
        if self._report is None:
            report = {k: dict(v) if isinstance(v, dict) else v for k, v in self.counts.items()}
            if self._dedup:
                rows = self.settled
                removal = dedupe.dedup_report(rows.valid, rows.kept, self._dedup, self._row_id)
                report["deduplication"] = removal.first().asDict()
                report["output_rows"] = report["deduplication"]["output_rows"]
            self._report = report
        return self._report


@dataclass(frozen=True)
class _Rows:
    """What becomes of a formatted table, with row ids."""

    valid: DataFrame
    rejected: DataFrame
    kept: DataFrame  # the valid ones that deduplication leaves
    hidden: str | None = None  # the row id, if results don't show it

    def shown(self, table: DataFrame) -> DataFrame:
        return table.drop(self.hidden) if self.hidden else table


def process_leads(df: DataFrame | LoadedCsv, config=None, row_id: str | None = None) -> LeadResult:
    """Recognise columns, format, validate, deduplicate.

    ``row_id`` names a column that says which row came first; it must be unique
    and the same on every run. Without one the table is staged with ids that follow
    files and lines, which the results do not show. The report of files that were read
    (``read_leads``) tells how many rows did not fit.
    """
    apart = None
    if isinstance(df, LoadedCsv):
        apart, df = df.malformed.count(), df.placed if row_id is None else df.df
    if not isinstance(df, DataFrame):
        raise TypeError(f"expected a Spark DataFrame, got {type(df).__name__}")
    cfg = settings(LeadConfig, config)
    spark = df.sparkSession
    key = row_id or GIVEN_ROW_ID
    if row_id is None:
        df = with_row_id(df, key)

    profile, cells, n_rows = _first_look(df, settings(SemanticConfig, cfg.semantic), key)
    if n_rows == 0:
        raise ValueError("the input table has no rows")

    look = _second_look(df, cfg, profile, cells, key)
    counts = {
        "input_rows": n_rows,
        "output_rows": n_rows,
        "rejected_rows": 0,
        "semantic_types_detected": profile.types_detected,
        "formatting": look.formatting,
        "validation": look.validation,
        "deduplication": {},
    }
    if apart is not None:
        counts["malformed_rows"] = apart
    if cfg.run_validation:
        counts["rejected_rows"] = look.validation["rejected_rows"]
        counts["output_rows"] = look.validation["valid_rows"]

    def split(table: DataFrame) -> _Rows:
        valid, rejected = table, spark.createDataFrame([], T.StructType([]))
        if cfg.run_validation:
            parts = validate.validate_leads(table, look.emails, cfg.validation)
            valid, rejected = parts.valid, parts.rejected
        kept = valid
        if cfg.run_deduplication:
            kept = dedupe.deduplicate_leads(valid, look.emails, cfg.deduplication, key)
        return _Rows(valid, rejected, kept, None if row_id else GIVEN_ROW_ID)

    rows = split(look.table)
    return LeadResult(
        spark, rows.shown(rows.kept), rows.shown(rows.rejected), profile, counts, _look=look, _split=split, _row_id=key,
        _dedup=settings(DedupConfig, cfg.deduplication) if cfg.run_deduplication else None,
    )


def _first_look(df: DataFrame, cfg: SemanticConfig, row_id: str):
    """(profile, counts per text column, rows)."""
    names = [n for n in semantic.text_columns(df) if n != row_id]
    if not names:
        return semantic.profile_from_counts(df, {}, cfg, row_id), {}, df.count()
    found = semantic.match_counts(df, names).collect()
    cells = {r["column"]: r.asDict() for r in found}
    rows = max((c["n_rows"] for c in cells.values()), default=0)
    return semantic.profile_from_counts(df, cells, cfg, row_id), cells, rows


@dataclass
class _Look:
    """The formatted table and what the second look found out about it."""

    table: DataFrame
    touched: tuple[str, ...]  # columns whose words formatting may have changed
    before: SemanticProfile
    cells: dict  # detector counts per column of the unformatted table
    cfg: SemanticConfig
    row_id: str
    emails: SemanticProfile = None  # what is an email column once formatted; nothing else
    formatting: dict = field(default_factory=dict)
    validation: dict = field(default_factory=dict)
    _judged: SemanticProfile | None = None

    def judged(self) -> SemanticProfile:
        """The formatted table's profile. Trimming never changes what a column means, so only
        the columns changed otherwise are judged again."""
        if self._judged is None:
            self._judged = self.before
            if self.touched:
                found = semantic.match_counts(self.table, list(self.touched)).collect()
                cells = {**self.cells, **{r["column"]: r.asDict() for r in found}}
                self._judged = semantic.profile_from_counts(self.table, cells, self.cfg, self.row_id)
        return self._judged


def _second_look(df, cfg: LeadConfig, profile, cells, row_id) -> _Look:
    """Format, and count in one narrow aggregate what formatting and validation do.

    Formatting leaves the email columns what they were but for two oddities,
    which the same aggregate watches for: letters outside ASCII that turn into
    ASCII ones in lower case, and name columns (or their split parts) with enough
    addresses among the names. Only then are the formatted columns judged again
    before validation.
    """
    judge, checks = settings(SemanticConfig, cfg.semantic), settings(ValidationConfig, cfg.validation)
    look, plan, counted = _Look(df, (), profile, cells, judge, row_id), None, []
    if cfg.run_formatting:
        style = settings(FormatConfig, cfg.formatting)
        plan = normalize.plan_format(df, profile, style, row_id)
        look.table, look.touched, counted = plan.table, plan.touched, list(plan.changes)
        look.formatting = dict.fromkeys(counted, 0)
        if style.trim_whitespace:
            # The first look has counted these cells; again would mean reading all text.
            counted.remove("whitespace_fixes")
            look.formatting["whitespace_fixes"] = sum(c["n_untrimmed"] for c in cells.values())
    look.emails = profile
    names = validate.email_columns(look.table, look.emails) if cfg.run_validation else []

    watched = [n for n in look.touched if n not in profile.of_type("email")]
    seen, aggregates = df, []
    if plan:
        counts = {f"f_{k}": plan.changes[k] for k in counted}
        seen = plan.table_with(**counts, f_newly_ascii=plan.newly_ascii)
        aggregates = [F.sum(k).alias(k) for k in (*counts, "f_newly_ascii")]
    seen = seen.withColumns({f"w_{i}": strip(col(n)) for i, n in enumerate(watched)})
    for i in range(len(watched)):
        text = F.col(f"w_{i}")
        aggregates.append(F.count_if(TESTS["email"](text, text)).alias(f"w_hits{i}"))
        aggregates.append(F.count_if(text != "").alias(f"w_values{i}"))
    if cfg.run_validation:
        seen = validate.check_leads(seen, names, checks, count_cells=True)
        counters = validate.validation_counters(checks)
        aggregates += [c.alias(f"v_{k}") for k, c in counters.items()]
    row = seen.agg(*aggregates).first().asDict() if aggregates else {}

    look.formatting.update({k: row[f"f_{k}"] for k in counted})
    look.validation = {k[2:]: v for k, v in row.items() if k.startswith("v_")}
    doubtful = bool(row.get("f_newly_ascii")) or any(
        _may_be_email(n, row[f"w_hits{i}"], row[f"w_values{i}"], judge)
        for i, n in enumerate(watched)
    )
    if doubtful:
        look.emails = look.judged()
        final = validate.email_columns(look.table, look.emails) if cfg.run_validation else []
        if final != names:
            look.validation = validate.validation_report(look.table, final, checks).first().asDict()
    return look


def _may_be_email(name: str, hits: int, values: int, cfg: SemanticConfig) -> bool:
    hinted = semantic.header_matches(name, "email")
    return values > 0 and semantic.confidence(hits, values, hinted, cfg) >= cfg.confidence_threshold
