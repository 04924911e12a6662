"""Type coercion: text columns that hold booleans, numbers or timestamps get that type.

All rates come from one aggregate over the text columns. It groups values by their shape, digits
and letters made alike, so that what a format looks like is compared with the few shapes that
occur, not with every value. Timestamp formats are only tried in a second aggregate, on columns
whose values have the shape of some format often enough, and there only those formats whose
shape occurs.
"""

from __future__ import annotations

import string
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecare import fixed_values as fv
from tablecare.config import CoercionConfig, settings
from tablecare.functions.columns import check_names, col, families
from tablecare.functions.parsing import (
    has_offset, is_bool_word, is_whole, to_bool, to_number, to_timestamp, to_whole,
)
from tablecare.functions.text import strip

CHANGE_SCHEMA = (
    "column STRING, from_dtype STRING, to_dtype STRING, cast_type STRING, success_rate DOUBLE"
)
ATTEMPT_SCHEMA = "column STRING, cast_type STRING, non_null BIGINT, parsed BIGINT, accepted BOOLEAN"


@dataclass(frozen=True)
class Change:
    column: str
    from_dtype: str
    to_dtype: str
    cast_type: str
    success_rate: float


@dataclass(frozen=True)
class Attempt:
    column: str
    cast_type: str
    non_null: int
    parsed: int
    accepted: bool


@dataclass
class Coerced:
    df: DataFrame
    changes: list[Change]
    attempts: list[Attempt]

    def changes_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(c).values()) for c in self.changes], CHANGE_SCHEMA)

    def attempts_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [tuple(asdict(a).values()) for a in self.attempts], ATTEMPT_SCHEMA
        )


def coerce_types(df: DataFrame, config=None) -> Coerced:
    """Cast every text column to the first type that fits: boolean, number, timestamp."""
    cfg = settings(CoercionConfig, config)
    check_names(df)
    texts = [n for n, kind in families(df).items() if kind == "string"]
    if not texts:
        return Coerced(df, [], [])
    rates = _rates(df, texts, cfg)
    attempts: list[Attempt] = []
    casts: dict[str, tuple[str, Column, Change]] = {}
    open_columns = []
    for n in texts:
        found = rates[n]
        if not found["values"]:
            continue
        for kind, parsed, needed in (
            ("bool", found["bools"], 1.0 if cfg.coerce_to_bool else None),
            ("numeric", found["numbers"],
             cfg.numeric_cast_success_threshold if cfg.coerce_to_numeric else None),
        ):
            if needed is None:
                continue
            rate = parsed / found["values"]
            attempts.append(Attempt(n, kind, found["values"], parsed, rate >= needed))
            if rate >= needed:
                casts[n] = _bool_or_number(n, kind, rate, found, cfg)
                break
        else:
            open_columns.append(n)
    if cfg.coerce_to_datetime:
        for n, fmt, parsed in _timestamps(df, open_columns, rates, cfg):
            rate = parsed / rates[n]["values"]
            fits = rate >= cfg.datetime_cast_success_threshold
            attempts.append(Attempt(n, "datetime", rates[n]["values"], parsed, fits))
            if fits:
                casts[n] = (
                    to_timestamp(col(n), *fmt),
                    Change(n, "string", "timestamp" if has_offset(fmt[0]) else "timestamp_ntz", "datetime", rate),
                )
    out = df
    if casts:
        stripped = df.withColumns({n: strip(col(n)) for n in casts})
        out = stripped.select(
            *[casts[n][0].alias(n) if n in casts else col(n) for n in df.columns]
        )
    return Coerced(out, [casts[n][1] for n in texts if n in casts], attempts)


def _bool_or_number(n: str, kind: str, rate: float, found: dict, cfg: CoercionConfig):
    if kind == "bool":
        value = to_bool(col(n), cfg.bool_true_values, cfg.bool_false_values)
        return value, Change(n, "string", "boolean", kind, rate)
    if found["whole"] == found["numbers"]:
        return to_whole(col(n)), Change(n, "string", "bigint", kind, rate)
    return to_number(col(n)), Change(n, "string", "double", kind, rate)


#: Digits become 9 and letters a, but for T and Z, which formats name.
_LETTERS = "".join(c for c in string.ascii_letters if c not in "TZ")
_SHORTEST, _LONGEST, _YEAR = 8, 32, "9999"


def _shape(text: Column) -> Column:
    """What a value looks like; NULL where it can't be a time. Any format's pattern fits the shape
    if it fits the value."""
    shape = F.translate(text, string.digits + _LETTERS, "9" * 10 + "a" * len(_LETTERS))
    return F.when(F.length(text).between(_SHORTEST, _LONGEST) & F.contains(shape, F.lit(_YEAR)), shape)


def _rates(df: DataFrame, texts: list[str], cfg: CoercionConfig) -> dict[str, dict]:
    """Per text column: values, how many read as boolean, number, whole number, or have the shape
    of any timestamp format, and the patterns of the shapes that occur."""
    patterns = list(dict.fromkeys(p for _, p in cfg.datetime_formats)) if cfg.coerce_to_datetime else []
    # Formats of a caller's own may name other letters and digits, so their values stand for themselves.
    looks = _shape if cfg.datetime_formats == fv.TIMESTAMP_FORMATS else (lambda text: text)
    cells = [c for i, n in enumerate(texts) for c in (F.lit(i), strip(col(n)))]
    values = df.select(F.stack(F.lit(len(texts)), *cells).alias("no", "text")).where("text IS NOT NULL")
    text, number = F.col("text"), F.col("number")
    looked_at = F.when(number.isNull() & (F.length(text) >= 6), looks(text)) if patterns else F.lit(None).cast("string")
    fits = F.concat(F.lit(""), *[F.when(F.col("shape").rlike(p), "1").otherwise("0") for p in patterns])
    sums = ("values", "bools", "numbers", "whole")
    rows = (
        values.withColumn("number", to_number(text))
        .withColumn("shape", looked_at)
        .groupBy("no", "shape")
        .agg(
            F.count("*").alias("values"),
            F.count_if(is_bool_word(text, cfg.bool_true_values, cfg.bool_false_values)).alias("bools"),
            F.count(number).alias("numbers"),
            F.count_if(is_whole(number)).alias("whole"),
        )
        .groupBy("no", fits.alias("fits"))
        .agg(*[F.sum(x).alias(x) for x in sums])
        .collect()
    )
    out = {n: dict.fromkeys((*sums, "dated"), 0) | {"patterns": set()} for n in texts}
    for r in rows:
        found = out[texts[r["no"]]]
        for x in sums:
            found[x] += r[x]
        fitting = {p for p, fit in zip(patterns, r["fits"]) if fit == "1"}
        found["dated"] += r["values"] if fitting else 0
        found["patterns"] |= fitting
    return out


def _timestamps(df: DataFrame, names: list[str], rates: dict, cfg: CoercionConfig):
    """(column, best format, parsed values) of every column worth trying; earlier formats win
    ties."""
    likely = [
        n for n in names
        if rates[n]["dated"] >= cfg.datetime_cast_success_threshold * rates[n]["values"]
    ]
    trials = [(n, fmt) for n in likely for fmt in cfg.datetime_formats if fmt[1] in rates[n]["patterns"]]
    if not trials:
        return []
    stripped = df.select(*[strip(col(n)).alias(n) for n in likely])
    row = stripped.agg(
        *[F.count(to_timestamp(col(n), *fmt)).alias(f"t{i}") for i, (n, fmt) in enumerate(trials)]
    ).first()
    best: dict[str, tuple] = {}
    for i, (n, fmt) in enumerate(trials):
        if n not in best or row[f"t{i}"] > best[n][2]:
            best[n] = (n, fmt, row[f"t{i}"])
    return list(best.values())
