"""Judge and clean messy tables with Spark."""

from tablecare.operators.clean import clean, filter_columns, handle_missing
from tablecare.operators.coerce import coerce_types
from tablecare.operators.dedupe import (
    count_duplicates, count_duplicates_by_digest, dedupe_by_email, deduplicate_leads, drop_exact_duplicates,
    drop_exact_duplicates_by_digest,
)
from tablecare.operators.frequencies import value_frequencies
from tablecare.operators.normalize import format_changes, format_leads
from tablecare.operators.profile import TableFacts, profile_table
from tablecare.operators.quality import (
    quality_score, quality_summary, run_quality_checks, suggest,
)
from tablecare.operators.report import audit_lines, report_table
from tablecare.operators.semantic import SemanticProfile, semantic_profile
from tablecare.operators.sketches import approximate_quantiles, approximate_types, approximate_unique
from tablecare.operators.validate import validate_leads
from tablecare.plans.audit import audit_csv, audit_table
from tablecare.plans.leads import process_leads
from tablecare.plans.profile_state import ProfileState
from tablecare.plans.survivors import Survivors
from tablecare.sources.csv import infer_delimiters, read_audit_csv, read_leads
from tablecare.sources.sinks import publish_lead_outputs, published_outputs, write_clean, write_lead_outputs
from tablecare.sources.staging import stage, staged_scope, with_row_id
from tablecare.streaming.leads import check_stream

__all__ = [
    "ProfileState", "SemanticProfile", "Survivors", "TableFacts", "audit_csv", "audit_lines", "report_table", "audit_table", "check_stream",
    "approximate_quantiles", "approximate_types", "approximate_unique", "count_duplicates_by_digest",
    "drop_exact_duplicates_by_digest", "publish_lead_outputs", "published_outputs", "staged_scope",
    "clean", "coerce_types", "count_duplicates", "dedupe_by_email", "deduplicate_leads",
    "drop_exact_duplicates", "filter_columns", "format_changes", "format_leads",
    "handle_missing", "infer_delimiters", "process_leads", "profile_table", "quality_score",
    "quality_summary", "read_audit_csv", "read_leads", "run_quality_checks", "semantic_profile",
    "stage", "suggest", "validate_leads", "value_frequencies", "with_row_id", "write_clean",
    "write_lead_outputs",
]
