"""From any table to its profile, issues, score, suggestions, a cleaned and typed copy, and
a report. Issues, score and suggestions describe the table as it came in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablecare.config import AuditConfig, settings
from tablecare.operators import clean as cleaning
from tablecare.operators import quality, report
from tablecare.operators.clean import Cleaned
from tablecare.operators.coerce import Coerced, coerce_types
from tablecare.operators.profile import TableFacts, profile_table
from tablecare.sources.csv import read_audit_csv
from tablecare.sources.sinks import write_clean


@dataclass
class AuditResult:
    spark: SparkSession
    facts: TableFacts
    issues: list[dict]
    score: dict
    suggestions: list[dict]
    cleaned: Cleaned
    coerced: Coerced
    lines: report.Lines  # the report, line by line

    @property
    def report(self) -> dict:
        """The report as one document for JSON."""
        return report.document(self.lines)

    @property
    def summary(self) -> dict:
        return report.audit_summary(self.lines)

    def report_df(self) -> DataFrame:
        return report.report_table(self.spark, self.lines)

    @property
    def clean_df(self) -> DataFrame:
        """The cleaned and typed table, lazy."""
        return self.coerced.df

    @property
    def clean_log(self) -> list[str]:
        return self.cleaned.log()

    def profile_df(self) -> DataFrame:
        return profile_table(self.facts)

    def issues_df(self) -> DataFrame:
        rows = [tuple(i.values()) for i in self.issues]
        return self.spark.createDataFrame(rows, quality.ISSUE_SCHEMA)

    def summary_df(self) -> DataFrame:
        summary = self.summary
        schema = ", ".join(
            f"{k} {'STRING' if isinstance(v, str) else 'DOUBLE' if isinstance(v, float) else 'BIGINT'}"
            for k, v in summary.items()
        )
        return self.spark.createDataFrame([tuple(summary.values())], schema)


def audit_table(df: DataFrame, config=None) -> AuditResult:
    """Run the whole audit on ``df``. Errors are raised, not wrapped."""
    cfg = settings(AuditConfig, config)
    facts = TableFacts(df)
    issues = quality.quality_issues(facts, cfg.quality)
    score = quality.score_of(facts)
    advice = quality.suggestions(facts)
    if cfg.skip_clean:
        cleaned = Cleaned(facts.df, facts.rows, retained_columns=list(facts.names))
    else:
        cleaned = cleaning.clean(facts, cfg.filter, cfg.missing)
    coerced = coerce_types(cleaned.df, cfg.coercion)
    lines = report.audit_lines(facts, issues, score, advice, cleaned, coerced, cfg.report)
    return AuditResult(df.sparkSession, facts, issues, score, advice, cleaned, coerced, lines)


def audit_csv(
    spark: SparkSession,
    path: str | list[str],
    config=None,
    sep: str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
    save_clean: str | None = None,
) -> AuditResult:
    """Audit CSV files: read, type, audit, and optionally save the cleaned table as CSV."""
    loaded = read_audit_csv(spark, path, sep, encoding, multi_line)
    result = audit_table(loaded.df, config)
    result.lines += [("load", k, v) for k, v in loaded.meta.items()]
    result.lines.append(("load", "malformed_rows", loaded.malformed.count()))
    if save_clean:
        write_clean(result.clean_df, save_clean)
    return result
