"""Cleaning: drop useless columns, then fill, drop or flag missing values.

What to do depends on the data, so each decision first asks ``TableFacts`` for
one-row results; the change itself is one lazy select or filter per family.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablecare import fixed_values as fv
from tablecare.config import FilterConfig, MissingConfig, settings
from tablecare.functions.columns import col, family, find_name
from tablecare.operators.profile import TableFacts, as_facts

DROPPED_SCHEMA = "column STRING, reason STRING"
ACTION_SCHEMA = (
    "column STRING, action STRING, fill_value STRING, nulls_filled BIGINT, "
    "rows_removed BIGINT, indicator_column STRING, reason STRING"
)


@dataclass
class Cleaned:
    df: DataFrame
    rows: int
    rows_dropped: int = 0
    dropped_columns: list[dict] = field(default_factory=list)
    retained_columns: list[str] = field(default_factory=list)
    actions: list[dict] = field(default_factory=list)

    def dropped_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(d["column"], d["reason"]) for d in self.dropped_columns], DROPPED_SCHEMA
        )

    def actions_df(self, spark: SparkSession) -> DataFrame:
        names = ("column", "action", "fill_value", "nulls_filled", "rows_removed",
                 "indicator_column", "reason")
        rows = []
        for a in self.actions:
            fill = a.get("fill_value")
            rows.append(tuple(
                (None if fill is None else str(fill)) if n == "fill_value" else a.get(n)
                for n in names
            ))
        return spark.createDataFrame(rows, ACTION_SCHEMA)

    def log(self) -> list[str]:
        return [f"{d['column']} left out: {d['reason']}" for d in self.dropped_columns] + [
            f"{a['column']}: {a['action']}" for a in self.actions
        ]


#: Why a column may go, in the order in which reasons count. Each gets facts, column and settings.
DROP_REASONS: tuple[Callable[[TableFacts, str, FilterConfig], str | None], ...] = (
    lambda f, n, cfg: fv.LISTED if n in {find_name(f.names, x) for x in cfg.force_drop_columns} else None,
    lambda f, n, cfg: f"{f.null_ratio(n) * 100:.1f} % absent, more than {cfg.null_drop_threshold * 100:g} %"
    if f.null_ratio(n) > cfg.null_drop_threshold
    else None,
    lambda f, n, cfg: fv.SINGLE_VALUE
    if cfg.drop_single_value_columns and f.rows >= cfg.single_value_min_rows and f.unique[n] <= 1
    else None,
)


def useless_columns(facts: TableFacts, config=None) -> list[dict]:
    """Columns to drop, each with the first reason that holds, reason by reason."""
    cfg = settings(FilterConfig, config)
    found: dict[str, str] = {}
    for holds in DROP_REASONS:
        found |= {n: why for n in facts.names if n not in found and (why := holds(facts, n, cfg))}
    return [{"column": n, "reason": why} for n, why in found.items()]


def filter_columns(table: DataFrame | TableFacts, config=None) -> Cleaned:
    facts = as_facts(table)
    dropped = useless_columns(facts, config)
    gone = {d["column"] for d in dropped}
    kept = [n for n in facts.names if n not in gone]
    df = facts.df.select(*[col(n) for n in kept])
    return Cleaned(df, facts.rows, dropped_columns=dropped, retained_columns=kept)


def handle_missing(
    table: DataFrame | TableFacts, config=None, only: list[str] | None = None
) -> Cleaned:
    """Treat missing values family by family: numbers, then everything else, then times.

    ``only`` restricts the table to these columns (facts about the others stay
    unused). Values are filled in one select. Dropping rows changes what later
    families see, so after a family that drops rows the facts are taken anew.
    """
    facts, cfg = as_facts(table), settings(MissingConfig, config)
    names = facts.names if only is None else only
    state = _State(facts, facts.df.select(*[col(n) for n in names]), names, facts.rows)
    start = facts.rows
    for members, strategy in (
        (("numeric",), cfg.numeric_strategy),
        (("string", "boolean", "nested"), cfg.categorical_strategy),
        (("datetime",), cfg.datetime_strategy),
    ):
        columns = [n for n in names if facts.family[n] in members]
        limit = None if members == ("datetime",) else cfg.impute_max_null_ratio
        if strategy == "drop_rows":
            state.drop_rows(columns, limit)
        else:
            state.fill_or_flag(columns, strategy, limit, cfg)
    return Cleaned(
        state.df, state.rows, start - state.rows, retained_columns=list(names),
        actions=state.actions,
    )


class _State:
    """The table between two families: its plan, its facts, and what was done so far."""

    def __init__(self, facts: TableFacts, df: DataFrame, names: list[str], rows: int):
        self.facts, self.df, self.names, self.rows = facts, df, names, rows
        self.original = df  # what the facts describe: rows dropped, nothing filled yet
        self.actions: list[dict] = []

    def _gaps(self, columns: list[str], limit: float | None) -> list[str]:
        """Columns with NULLs to treat; too sparse ones are logged as skipped."""
        out = []
        for n in columns:
            if not self.facts.nulls(n):
                continue
            if limit is not None and self.facts.null_ratio(n) > limit:
                self._skip(n)
            else:
                out.append(n)
        return out

    def _skip(self, n: str) -> None:
        self.actions.append(
            {"column": n, "action": fv.SKIPPED, "reason": fv.TOO_SPARSE}
        )

    def fill_or_flag(self, columns, strategy, limit, cfg) -> None:
        replaced, flags = {}, {}
        for n in self._gaps(columns, limit):
            if strategy == "flag":
                flag = n + fv.FLAG_SUFFIX
                flags[flag] = col(n).isNull()
                action = {"action": fv.FLAGGED, "indicator_column": flag}
            else:
                value, action = _filler(self.facts, n, strategy, cfg)
                if value is not None:
                    replaced[n] = _filled(self.df.schema[n], value, strategy)
            self.actions.append({"column": n, **action})
        if replaced or flags:
            self.df = self.df.withColumns({**replaced, **flags})

    def drop_rows(self, columns, limit) -> None:
        """Drop rows column by column, each seeing what the ones before it left.

        One aggregate counts, for every column in turn, its NULLs among the rows
        that all earlier columns leave. Only a column that turns out to be too
        sparse (and is kept) makes the counts after it void, and they are redone.
        """
        left = [n for n in columns if self.facts.nulls(n)]
        dropped: list[str] = []
        while left:
            alive = [F.count("*").alias("n0")]
            nulls = []
            passed = F.lit(True)
            for i, n in enumerate(left):
                nulls.append(F.count_if(passed & col(n).isNull()).alias(f"null{i}"))
                passed = passed & col(n).isNotNull()
            base = _without_nulls(self.original, dropped)
            row = base.agg(*alive, *nulls).first()
            rows, sparse = row["n0"], None
            for i, n in enumerate(left):
                missing = row[f"null{i}"]
                if not missing:
                    continue
                if limit is not None and rows and missing / rows > limit:
                    self._skip(n)
                    sparse = i
                    break
                self.actions.append(
                    {"column": n, "action": fv.ROWS_DROPPED, "rows_removed": missing}
                )
                dropped.append(n)
                rows -= missing
            self.rows = rows
            left = left[sparse + 1:] if sparse is not None else []
        if dropped:
            self.df = _without_nulls(self.df, dropped)
            self.original = _without_nulls(self.original, dropped)
            self.facts = TableFacts(self.original)


def _without_nulls(df: DataFrame, names: list[str]) -> DataFrame:
    for n in names:
        df = df.filter(col(n).isNotNull())
    return df


#: Decimal places of fills that stay exact.
EXACT_PLACES = 4

#: Per strategy: whether it suits a family, and the value it fills with (None if there is none).
FILLINGS: dict[str, tuple[Callable[[str], bool], Callable[[TableFacts, str, MissingConfig], object]]] = {
    "mean": (lambda kind: kind == "numeric", lambda f, n, cfg: f.stats(n).get("mean")),
    "median": (lambda kind: kind == "numeric", lambda f, n, cfg: f.stats(n).get("median")),
    "mode": (lambda kind: kind != "numeric", lambda f, n, cfg: f.modes.get(n)),
    "constant": (
        lambda kind: True,
        lambda f, n, cfg: {"numeric": cfg.numeric_fill_value, "nested": None}.get(
            f.family[n], cfg.categorical_fill_value
        ),
    ),
}


def _filler(facts: TableFacts, n: str, strategy: str, cfg: MissingConfig):
    """(value, log entry) for filling column ``n``; no value when it cannot be filled."""
    suits, value_of = FILLINGS.get(strategy, (lambda kind: False, None))
    kind = facts.family[n]
    if not suits(kind):
        return None, {"action": fv.LEFT_ALONE, "reason": f"{kind} columns know no {strategy!r}"}
    value = value_of(facts, n, cfg)
    if strategy in ("mean", "median") and value is not None and not facts.fits_double(n):
        exact = facts.exact_median(n) if strategy == "median" else value
        value = Decimal(exact).quantize(Decimal(10) ** -EXACT_PLACES)
    if value is None:
        return None, {"action": fv.LEFT_ALONE, "reason": f"no {strategy} of {facts.non_null[n]} {kind} values"}
    shown = round(value, 4) if strategy in ("mean", "median") else value
    return value, {"action": fv.FILLED + strategy, "fill_value": shown, "nulls_filled": facts.nulls(n)}


def _filled(f: T.StructField, value, strategy: str) -> Column:
    """The column with NULLs replaced. Mean and median make it a DOUBLE, or a DECIMAL where that would
    change what is there (whole numbers and decimals beyond 2**53); a constant keeps the
    type where it fits (whole numbers in whole columns), text fills turn others into text."""
    c = col(f.name)
    whole = isinstance(f.dataType, T.IntegralType)
    if family(f.dataType) == "numeric":
        if strategy == "constant" and (float(value).is_integer() or not whole):
            return F.coalesce(c, F.lit(value).cast(f.dataType))
        if isinstance(value, Decimal):
            places = max(EXACT_PLACES, getattr(f.dataType, "scale", 0))
            wide = T.DecimalType(min(38, 20 + places), places)
            return F.coalesce(c.cast(wide), F.lit(str(value)).cast(wide))
        return F.coalesce(c.cast("double"), F.lit(float(value)))
    if isinstance(value, bool):
        return F.coalesce(c, F.lit(value))
    return F.coalesce(c.cast("string"), F.lit(value))


def clean(table: DataFrame | TableFacts, filter_config=None, missing_config=None) -> Cleaned:
    """Drop useless columns, then handle missing values. The facts about the kept columns
    serve both steps, since dropping columns leaves them true."""
    facts = as_facts(table)
    filtered = filter_columns(facts, filter_config)
    done = handle_missing(facts, missing_config, only=filtered.retained_columns)
    done.dropped_columns = filtered.dropped_columns
    return done
