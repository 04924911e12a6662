"""The report of an audit: one long table of (section, item, value), and documents made from it.

Values are numbers, words or small lists; each appears once. ``document`` nests them for JSON,
``report_table`` shows them as rows of text, ``audit_summary`` picks the headline figures.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecare import fixed_values as fv
from tablecare.config import ReportConfig, settings
from tablecare.operators.clean import Cleaned
from tablecare.operators.coerce import Coerced
from tablecare.operators.profile import TableFacts, profile_rows
from tablecare.operators.quality import report_grade, report_status

REPORT_SCHEMA = "section STRING, item STRING, value STRING"
Lines = list[tuple[str, str, object]]


def kind_of(action: str) -> str:
    """What an action of cleaning comes to, whatever the filling was."""
    return "filled" if action.startswith(fv.FILLED) else action


def size_lines(facts: TableFacts, final: DataFrame, rows_final: int) -> Lines:
    """Rows and columns before and after."""
    sizes = {"rows": (facts.rows, rows_final), "columns": (len(facts.names), len(final.columns))}
    lines: Lines = []
    for what, (before, after) in sizes.items():
        lines += [("size", f"{what}_before", before), ("size", f"{what}_after", after), ("size", f"{what}_lost", before - after)]
    return lines + [("size", "names_before", list(facts.names)), ("size", "names_after", list(final.columns))]


def column_lines(facts: TableFacts) -> Lines:
    """One line for each column: what its profile says, without what does not apply."""
    return [
        ("columns", r["column"], {k: v for k, v in r.items() if v is not None and k != "column"})
        for r in profile_rows(facts)
    ]


def score_lines(score: dict, issues: list[dict]) -> Lines:
    critical = Counter(i["severity"] for i in issues)["critical"]
    return [
        ("score", "score", score["score"]),
        ("score", "label", score["grade"]),
        ("score", "grade", report_grade(score["score"], critical)),
        ("score", "status", report_status(score["score"], critical)),
        *(("score", f"{flaw}_penalty", taken) for flaw, taken in score["breakdown"].items()),
    ]


def cleaning_lines(cleaned: Cleaned) -> Lines:
    done = Counter(kind_of(a["action"]) for a in cleaned.actions)
    return [
        ("cleaning", "left_out", {d["column"]: d["reason"] for d in cleaned.dropped_columns}),
        ("cleaning", "kept", cleaned.retained_columns),
        *(("cleaning", kind, n) for kind, n in sorted(done.items())),
        ("cleaning", "rows_lost", cleaned.rows_dropped),
        ("cleaning", "log", cleaned.actions),
    ]


def typing_lines(coerced: Coerced) -> Lines:
    types = dict.fromkeys(c.cast_type for c in coerced.changes)
    return [
        ("types", "cast", len(coerced.changes)),
        *(("types", f"to_{t}", [c.column for c in coerced.changes if c.cast_type == t]) for t in types),
        ("types", "changes", [asdict(c) for c in coerced.changes]),
        ("types", "attempts", [asdict(a) for a in coerced.attempts]),
    ]


def audit_lines(
    facts: TableFacts,
    issues: list[dict],
    score: dict,
    advice: list[dict],
    cleaned: Cleaned,
    coerced: Coerced,
    config=None,
) -> Lines:
    """The whole report, section after section."""
    shows_cleaning = settings(ReportConfig, config).show_cleaning_summary
    return [
        *size_lines(facts, coerced.df, cleaned.rows),
        *score_lines(score, issues),
        *column_lines(facts),
        *(("issues", f"{i}", x) for i, x in enumerate(issues, 1)),
        *(("advice", f"{i}", x) for i, x in enumerate(advice, 1)),
        *(cleaning_lines(cleaned) if shows_cleaning else ()),
        *typing_lines(coerced),
    ]


def document(lines: Lines) -> dict:
    """{section: {item: value}}."""
    out: dict[str, dict] = {}
    for section, item, value in lines:
        out.setdefault(section, {})[item] = value
    return out


def report_table(spark: SparkSession, lines: Lines) -> DataFrame:
    """(section, item, value) with words as they are and everything else as JSON."""
    shown = [(s, i, v if isinstance(v, str) else json.dumps(v, default=str)) for s, i, v in lines]
    return spark.createDataFrame(shown, REPORT_SCHEMA)


def audit_summary(lines: Lines) -> dict:
    """The headline figures of a report."""
    found = document(lines)
    size, score = found["size"], found["score"]
    return {
        **{k: v for k, v in size.items() if isinstance(v, int)},
        "columns_cast": found["types"]["cast"],
        "score": score["score"],
        "label": score["label"],
    }


def actions_by_kind(actions: DataFrame) -> DataFrame:
    """(kind, columns) from an action log: how many columns were filled, flagged and so on."""
    kind = F.when(F.col("action").startswith(fv.FILLED), "filled").otherwise(F.col("action"))
    return actions.groupBy(kind.alias("kind")).agg(F.count("*").alias("columns"))


def casts_by_type(changes: DataFrame) -> DataFrame:
    """(cast_type, columns, n_columns) from a change log."""
    return changes.groupBy("cast_type").agg(
        F.array_sort(F.collect_list("column")).alias("columns"),
        F.count("*").alias("n_columns"),
    )
