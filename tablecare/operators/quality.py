"""Quality findings, the 0-100 score, and advice, as tables of rules over facts.

A rule measures one thing about a scope, which is a column or the whole table. What it measures
decides, by a ladder of limits, whether it is worth telling and how grave it is; what is told is
a template over the scope. Nothing here reads the table again: scopes look facts up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablecare import fixed_values as fv
from tablecare.config import QualityConfig, settings
from tablecare.operators.profile import TableFacts, as_facts

ISSUE_SCHEMA = "column STRING, check STRING, severity STRING, message STRING, affected BIGINT"
SUGGESTION_SCHEMA = "type STRING, severity STRING, scope STRING, message STRING, action STRING"


@dataclass(frozen=True)
class Scope:
    """A column, or with no name the whole table, as rules and their templates see it."""

    facts: TableFacts
    name: str | None = None
    factor: float = fv.IQR_FACTOR

    @property
    def rows(self) -> int:
        return self.facts.rows

    @property
    def values(self) -> int:
        return self.facts.non_null[self.name]

    @property
    def gaps(self) -> int:
        return self.facts.nulls(self.name)

    @property
    def gap_pct(self) -> float:
        return self.facts.null_ratio(self.name) * 100

    @property
    def copies(self) -> int:
        return self.facts.duplicate_rows

    @property
    def copy_pct(self) -> float:
        return self.copies / self.rows * 100 if self.rows else 0.0

    @property
    def distinct(self) -> int:
        return self.facts.unique[self.name]

    @property
    def uniform(self) -> bool:
        return self.distinct < 2

    @property
    def kind(self) -> str:
        return self.facts.family[self.name]

    @property
    def far_values(self) -> int:
        return self.facts.outliers(self.factor).get(self.name, 0)

    @property
    def fences(self) -> str:
        return "{:.2f} to {:.2f}".format(*self.facts.fences(self.name, self.factor))

    @property
    def number_share(self) -> float:
        return self.facts.numbers[self.name] / self.values if self.kind == "string" and self.values else 0.0

    @property
    def number_pct(self) -> float:
        return self.number_share * 100

    @property
    def filling(self) -> str:
        """What could stand in for the gaps."""
        if self.kind == "numeric":
            return "its median, or its mean if both tails are alike"
        common = self.facts.modes.get(self.name)
        return "a word of their own" if common is None else f"its commonest value ({common}) or a word of their own"


Ladder = tuple[tuple[float, str], ...]


@dataclass(frozen=True)
class Rule:
    """``measure`` of a scope, and from what it must exceed for which severity, gravest first."""

    code: str
    measure: Callable[[Scope], float]
    ladder: Ladder
    tells: str
    remedy: str = ""
    affects: Callable[[Scope], int] = lambda s: s.rows
    whole_table: bool = False

    def findings(self, facts: TableFacts, factor: float) -> Iterator[tuple[Scope, str]]:
        scopes = [Scope(facts, None, factor)] if self.whole_table else [Scope(facts, n, factor) for n in facts.names]
        for scope in scopes:
            amount = self.measure(scope)
            severity = next((word for limit, word in self.ladder if amount > limit), None)
            if severity:
                yield scope, severity


def issue_rules(cfg: QualityConfig) -> dict[str, Rule]:
    """The rules for issues, by code, in the order in which issues are listed."""
    rules = [
        Rule(
            fv.MISSING,
            lambda s: round(s.gap_pct, 2),
            ((cfg.null_critical_threshold, "critical"), (cfg.null_warning_threshold, "warning")),
            "{s.gaps} of {s.rows} values are absent",
            affects=lambda s: s.gaps,
        ),
        Rule(
            fv.DUPLICATES,
            lambda s: s.copies,
            ((0, "warning"),),
            "{s.copies} rows are copies of other rows",
            affects=lambda s: s.copies,
            whole_table=True,
        ),
        Rule(fv.CONSTANT, lambda s: s.uniform, ((0, "warning"),), "no two values differ, so nothing can be learned from it"),
        # By default the limits exclude each other: categorical columns have few values.
        Rule(
            fv.HIGH_CARDINALITY,
            lambda s: s.distinct if s.facts.inferred_type(s.name) == "categorical" else 0,
            ((cfg.high_cardinality_min_unique, "info"),),
            "{s.distinct} categories are many",
            affects=lambda s: s.distinct,
        ),
    ]
    if cfg.enable_outlier_checks:
        rules.append(
            Rule(
                fv.OUTLIERS,
                lambda s: s.far_values,
                ((0, "warning"),),
                "{s.far_values} values lie more than {s.factor:g} interquartile ranges outside the quartiles",
                affects=lambda s: s.far_values,
            )
        )
    return {r.code: r for r in rules}


#: Severity words of advice, gravest first.
GRAVITY = ("high", "medium", "low")

ADVICE = {
    r.code: r
    for r in (
        Rule(
            fv.MISSING,
            lambda s: s.gap_pct,
            ((fv.SUGGEST_MISSING_HIGH_PCT, "high"), (fv.SUGGEST_MISSING_MEDIUM_PCT, "medium"), (0, "low")),
            "{s.gap_pct:.1f} % of {s.name} is absent",
            "Put {s.filling} into the {s.gaps} gaps.",
        ),
        Rule(
            fv.DUPLICATES,
            lambda s: s.copy_pct,
            ((fv.SUGGEST_DUPLICATES_HIGH_PCT, "high"), (0, "medium")),
            "{s.copy_pct:.1f} % of the rows are copies",
            "Keep one of each and let {s.copies} rows go.",
            whole_table=True,
        ),
        Rule(
            fv.CONSTANT,
            lambda s: s.uniform,
            ((0, "medium"),),
            "{s.name} is the same in every row",
            "Leave {s.name} out.",
        ),
        Rule(
            fv.OUTLIERS,
            lambda s: s.far_values if s.values >= fv.OUTLIER_MIN_VALUES else 0,
            ((0, "medium"),),
            "{s.far_values} values of {s.name} lie outside {s.fences}",
            "Look at them, or limit {s.name} to {s.fences}.",
        ),
        Rule(
            fv.TYPE_CONVERSION,
            lambda s: s.number_share >= fv.SUGGEST_NUMERIC_RATE,
            ((0, "low"),),
            "{s.number_pct:.0f} % of the texts in {s.name} are numbers",
            "Store {s.name} as numbers.",
        ),
        Rule(
            fv.HIGH_CARDINALITY,
            lambda s: s.distinct
            if s.kind == "string" and s.values and s.distinct / s.values < fv.HIGH_CARDINALITY_MAX_RATIO
            else 0,
            ((fv.HIGH_CARDINALITY_MIN_UNIQUE, "low"),),
            "{s.name} has {s.distinct} different texts that recur",
            "Merge rare ones, or code them by how often or with what result they occur.",
        ),
    )
}


def quality_issues(table: DataFrame | TableFacts, config=None, checks=None) -> list[dict]:
    """What is wrong, rule by rule; ``checks`` names the rules wanted, all by default."""
    facts, cfg = as_facts(table), settings(QualityConfig, config)
    if checks is None:
        facts.gather()
    return [
        {
            "column": scope.name or fv.ALL_COLUMNS,
            "check": rule.code,
            "severity": severity,
            "message": rule.tells.format(s=scope),
            "affected": int(rule.affects(scope)),
        }
        for code, rule in issue_rules(cfg).items()
        if checks is None or code in checks
        for scope, severity in rule.findings(facts, float(cfg.outlier_iqr_factor))
    ]


def run_quality_checks(table: DataFrame | TableFacts, config=None, checks=None) -> DataFrame:
    facts = as_facts(table)
    issues = quality_issues(facts, config, checks)
    return facts.spark.createDataFrame([tuple(i.values()) for i in issues], ISSUE_SCHEMA)


def quality_summary(issues: DataFrame) -> DataFrame:
    """One row: how many issues of each severity, and of any."""
    return issues.groupBy().agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")],
        F.count("*").alias("total"),
    )


def suggestions(table: DataFrame | TableFacts, rules=None) -> list[dict]:
    """Advice, the gravest first and else in the order of rules and columns; none on empty tables."""
    facts = as_facts(table)
    if not facts.rows:
        return []
    if rules is None:
        facts.gather()
    found = [
        {
            "type": rule.code,
            "severity": severity,
            "scope": scope.name or fv.WHOLE_TABLE,
            "message": rule.tells.format(s=scope),
            "action": rule.remedy.format(s=scope),
        }
        for code, rule in ADVICE.items()
        if rules is None or code in rules
        for scope, severity in rule.findings(facts, fv.IQR_FACTOR)
    ]
    return sorted(found, key=lambda s: GRAVITY.index(s["severity"]))


def suggest(table: DataFrame | TableFacts, rules=None) -> DataFrame:
    """Advice with its place in the list, since a table has no order of its own."""
    facts = as_facts(table)
    rows = [(i, *s.values()) for i, s in enumerate(suggestions(facts, rules), 1)]
    return facts.spark.createDataFrame(rows, "place BIGINT, " + SUGGESTION_SCHEMA)


# --- score -------------------------------------------------------------------

#: What is counted against a table: a measure, its weight and the most it takes off.
FLAWS: dict[str, tuple[Callable[[TableFacts], float], tuple[float, float]]] = {
    "missing": (lambda f: sum(map(f.nulls, f.names)) / (f.rows * len(f.names)) * 100, fv.MISSING_PENALTY),
    "duplicates": (lambda f: f.duplicate_rows / f.rows * 100, fv.DUPLICATE_PENALTY),
    "constant": (lambda f: sum(Scope(f, n).uniform for n in f.names), fv.CONSTANT_PENALTY),
    "outliers": (
        lambda f: sum(far > 0 and f.non_null[n] >= fv.OUTLIER_MIN_VALUES for n, far in f.outliers().items()),
        fv.OUTLIER_PENALTY,
    ),
}


def penalties(table: DataFrame | TableFacts) -> dict[str, float]:
    """What each kind of flaw takes off the score."""
    facts = as_facts(table)
    empty = not (facts.rows and facts.names)
    if not empty:
        facts.gather()
    return {
        name: 0.0 if empty else min(measure(facts) * weight, most) for name, (measure, (weight, most)) in FLAWS.items()
    }


def score_of(facts: TableFacts) -> dict:
    """Score from 0 to 100, its label, and the penalties that led to it. Empty tables get 0."""
    parts = penalties(facts)
    score = 0.0
    if facts.rows and facts.names:
        score = round(max(100.0 - sum(parts.values()), 0.0), 2)
    return {"score": score, "grade": score_label(score), "breakdown": parts}


def quality_score(table: DataFrame | TableFacts) -> DataFrame:
    """One row: score, grade and the four penalties."""
    facts = as_facts(table)
    found = score_of(facts)
    row = (found["score"], found["grade"], *found["breakdown"].values())
    schema = "score DOUBLE, grade STRING, " + ", ".join(f"{name}_penalty DOUBLE" for name in found["breakdown"])
    return facts.spark.createDataFrame([row], schema)


def _ladder(score: float, steps, lowest: str) -> str:
    return next((label for limit, label in steps if score >= limit), lowest)


def score_label(score: float) -> str:
    return _ladder(score, fv.SCORE_LABELS, fv.SCORE_LABEL_LOWEST)


def report_grade(score: float, critical: int = 0) -> str:
    """School grade of a report; any critical issue overrides the score."""
    if critical:
        return fv.REPORT_GRADE_CRITICAL
    return _ladder(score, fv.REPORT_GRADES, fv.REPORT_GRADE_LOWEST)


def report_status(score: float, critical: int = 0) -> str:
    if critical:
        return fv.REPORT_STATUS_CRITICAL
    return _ladder(score, fv.REPORT_STATUSES, fv.REPORT_STATUS_LOWEST)


def grade_columns(score: Column, critical: Column) -> dict[str, Column]:
    """Label, grade and status as column expressions, to grade a table of scores."""

    def ladder(steps, lowest):
        out = F
        for limit, label in steps:
            out = out.when(score >= limit, label)
        return out.otherwise(lowest)

    def unless_critical(word, otherwise):
        return F.when(critical > 0, word).otherwise(otherwise)

    return {
        "grade": ladder(fv.SCORE_LABELS, fv.SCORE_LABEL_LOWEST),
        "report_grade": unless_critical(
            fv.REPORT_GRADE_CRITICAL, ladder(fv.REPORT_GRADES, fv.REPORT_GRADE_LOWEST)
        ),
        "report_status": unless_critical(
            fv.REPORT_STATUS_CRITICAL, ladder(fv.REPORT_STATUSES, fv.REPORT_STATUS_LOWEST)
        ),
    }
