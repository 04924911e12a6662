"""Formatting and validation of arriving leads.

Both steps work row by row, so they run unchanged on a streaming table. What
the columns mean cannot be learned from a stream that has not arrived: it comes
from a profile of rows already at hand. Deduplication needs all rows of an
address and stays with the batch plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablecare.operators.normalize import format_leads
from tablecare.operators.semantic import SemanticProfile
from tablecare.operators.validate import check_leads


def check_stream(stream: DataFrame, profile: SemanticProfile, formatting=None, validation=None):
    """``stream`` formatted, with ``rejection_reason`` and ``is_role_email`` on every row."""
    formatted = format_leads(stream, profile, formatting)
    return check_leads(formatted, profile.of_type("email"), validation)
