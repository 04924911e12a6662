"""Approximate profiles, for those who ask for them, with bounds that are stated.

Distinct values are estimated by HyperLogLog sketches of 2**``PRECISION`` registers, quantiles by
KLL sketches with parameter ``KLL_K``. Both are merged from task to task and are a few kilobytes each,
so a table of any size is one pass and one small row; no value is shuffled.

``approximate_types`` uses them only where they are enough. A column's type depends on whether its
distinct values are more than a share of all, or more than a number. If ``DEVIATIONS`` standard
errors on either side of the estimate leave that open, the column is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablecare import fixed_values as fv
from tablecare.functions.columns import check_names, col, families, nan_as_null
from tablecare.operators.frequencies import _carried, _carrier, unique_counts

PRECISION, KLL_K = 14, 400
#: Standard errors that a bound is away from its estimate.
DEVIATIONS = 4
#: The error of one standard deviation of an estimate of distinct values, as a share of them.
UNIQUE_ERROR = 1.04 / math.sqrt(2**PRECISION)
#: How far, as a share of all values, a value's rank may be from the one asked for (99 % of the time).
RANK_ERROR = 2.296 / KLL_K**0.9021


def approximate_unique(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, tuple[int, float, float]]:
    """Per column: values that are not NULL, and the bounds between which the number of distinct ones lies."""
    df = nan_as_null(df)
    names = list(df.columns if names is None else names)
    types = {f.name: f.dataType for f in df.schema.fields}
    sketched = []
    for i, n in enumerate(names):
        # Sketches take whole numbers and text; a DOUBLE's bits are a whole number.
        carrier = _carrier(types[n])
        value = _carried(n, types[n], carrier)
        value = value if carrier != "double" else F.xxhash64(value + F.lit(0.0))
        value = F.when(col(n).isNotNull(), value)
        sketched += [F.count(col(n)).alias(f"n{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(PRECISION))).alias(f"u{i}")]
    row = df.agg(*sketched).first()
    margin = DEVIATIONS * UNIQUE_ERROR
    out = {}
    for i, n in enumerate(names):
        values, estimate = row[f"n{i}"], row[f"u{i}"] or 0
        out[n] = (values, min(values, estimate / (1 + margin)), min(values, estimate / (1 - margin)))
    return out


def approximate_quantiles(df: DataFrame, names: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float] | None]:
    """Per numeric column: a value of it near each rank, off by ``RANK_ERROR`` of all values at most; None without values."""
    df = nan_as_null(df)
    sketches = []
    for i, n in enumerate(names):
        sketch = F.kll_sketch_agg_double(col(n).cast("double"), F.lit(KLL_K))
        asked = F.array(*[F.lit(float(p)) for p in probabilities])
        found = F.when(F.count(col(n)) > 0, F.kll_sketch_get_quantile_double(sketch, asked))
        sketches.append(found.alias(f"q{i}"))
    row = df.agg(*sketches).first()
    return {n: row[f"q{i}"] for i, n in enumerate(names)}


def approximate_types(df: DataFrame) -> DataFrame:
    """(column, inferred_type, unique_low, unique_high): types as ``profile_table`` gives them, the
    same ones, with the number of distinct values counted only where bounds leave the type open."""
    check_names(df)
    kinds = families(df)
    bounds = approximate_unique(df)
    open_columns = [n for n, b in bounds.items() if _type(kinds[n], *b) is None]
    if open_columns:
        exact = {r["column"]: r["unique"] for r in unique_counts(df, open_columns).collect()}
        bounds.update((n, (bounds[n][0], exact.get(n, 0), exact.get(n, 0))) for n in open_columns)
    rows = [(n, _type(kinds[n], *b), int(b[1]), math.ceil(b[2])) for n, b in bounds.items()]
    return df.sparkSession.createDataFrame(
        rows, "column STRING, inferred_type STRING, unique_low BIGINT, unique_high BIGINT"
    )


def _type(kind: str, values: int, low: float, high: float) -> str | None:
    """The type of a column with between ``low`` and ``high`` distinct values; None if these differ in type."""
    if not values:
        return "empty"
    if kind in ("numeric", "nested"):
        return kind

    def of(unique: float) -> str:
        if unique / values > fv.IDENTIFIER_RATIO:
            return "identifier"
        return "categorical" if unique <= fv.CATEGORICAL_MAX_UNIQUE else "freetext"

    # More distinct values only ever lead from one type to the next, so the ends tell what lies between.
    found = {of(low), of(high)}
    return found.pop() if len(found) == 1 else None
