"""How often every value of every column occurs: the base of unique counts and modes.

The table is melted per type group, so numbers are counted as numbers and only
text travels as text: whole numbers, dates and timestamps as BIGINT, floating
numbers as DOUBLE, the rest as STRING. Each group reads its own columns only,
equal values are combined in the map tasks, and no step gathers the values of a
column in one place.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecare.functions.columns import col, families, family, groupable, nan_as_null
from tablecare.operators.quantiles import counted_facts
from tablecare.sources.staging import in_scope

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def _carrier(dtype: T.DataType) -> str:
    """The type in which values of ``dtype`` can be counted without loss."""
    if isinstance(dtype, (*_WHOLE, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "bigint"
    return "double" if isinstance(dtype, _FLOATING) else "string"


def _carried(name: str, dtype: T.DataType, carrier: str) -> Column:
    c = col(name)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if family(dtype) == "nested":
        return F.when(c.isNotNull(), F.to_json(F.struct(groupable(c, dtype).alias("v"))))
    if carrier == "bigint" and isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if carrier == "bigint" and isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, c)
    if carrier == "bigint" and isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint")
    return c.cast(carrier)


@dataclass(frozen=True)
class FrequencyGroup:
    carrier: str
    names: tuple[str, ...]  # position = column_no
    table: DataFrame  # column_no, value, n


def frequency_groups(
    df: DataFrame, names: list[str] | None = None, as_text: bool = False
) -> list[FrequencyGroup]:
    """(column_no, value, n) per carrier type, for the named columns; NULLs left out.

    With ``as_text`` all columns share one group whose values are text.
    """
    df = nan_as_null(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = df.columns if names is None else names
    carriers = {n: "string" if as_text else _carrier(types[n]) for n in wanted}
    groups = []
    for carrier in ("bigint", "double", "string"):
        members = [n for n in wanted if carriers[n] == carrier]
        if not members:
            continue
        cells = [
            c for i, n in enumerate(members) for c in (F.lit(i), _carried(n, types[n], carrier))
        ]
        table = (
            df.select(F.stack(F.lit(len(members)), *cells).alias("column_no", "value"))
            .filter(F.col("value").isNotNull())
            .groupBy("column_no", "value")
            .agg(F.count("*").alias("n"))
        )
        groups.append(FrequencyGroup(carrier, tuple(members), table))
    return groups


def _named(group: FrequencyGroup) -> Column:
    pairs = [x for i, n in enumerate(group.names) for x in (F.lit(i), F.lit(n))]
    return F.create_map(*pairs)[F.col("column_no")]


def value_frequencies(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, value, number, n): values as text, numbers also as DOUBLE; NULLs left out."""
    kinds = families(df)
    (group,) = frequency_groups(df, names, as_text=True)
    numeric = [n for n in group.names if kinds[n] == "numeric"]
    return group.table.withColumn("column", _named(group)).select(
        "column",
        "value",
        F.when(F.col("column").isin(numeric), F.col("value").try_cast("double")).alias("number"),
        "n",
    )


def distinct_facts(df: DataFrame, names: list[str], probabilities: list[float] = ()) -> dict[str, dict]:
    """Per column that has values: ``unique``, the exact number of its distinct values; ``mode``, the
    most frequent as text, the smallest of equally frequent ones; and of numbers ``quantiles``, exact
    for whole numbers and for decimals of up to 18 digits.

    Values are counted once; numbers and times then share one table of counted values.
    """
    return facts_of_groups(frequency_groups(df, names), df.schema, names, probabilities)


def facts_of_groups(
    groups: list[FrequencyGroup], schema: T.StructType, names: list[str], probabilities: list[float] = ()
) -> dict[str, dict]:
    """``distinct_facts`` from counted values."""
    types = {f.name: f.dataType for f in schema.fields}
    counted, measured = [], []
    for g in groups:
        place = F.element_at(F.array(*[F.lit(names.index(n)) for n in g.names]), F.col("column_no") + 1)
        value = F.col("value").cast("double").alias("value")
        none = F.lit(None).cast("bigint").alias("exact")
        if g.carrier != "string":
            exact = F.col("value").alias("exact") if g.carrier == "bigint" else none
            measured.append(g.table.select(place.alias("id"), value, exact, "n", F.lit(True).alias("own")))
            continue
        top = F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("top")
        counted.append(g.table.groupBy(place.alias("id")).agg(F.count("*").alias("unique"), top))
        # Decimals are counted as text, so that none is lost, and measured as numbers.
        decimals = [i for i, n in enumerate(g.names) if family(types[n]) == "numeric"]
        if decimals and probabilities:
            some = g.table.where(F.col("column_no").isin(decimals))
            unscaled = [_unscaled(F.col("value"), types[g.names[i]]) for i in decimals]
            exact = F.coalesce(*[F.when(F.col("column_no") == i, x) for i, x in zip(decimals, unscaled)], none)
            measured.append(some.select(place.alias("id"), value, exact.alias("exact"), "n", F.lit(False).alias("own")))
    # Words and numbers are two jobs that do not wait for each other.
    with ThreadPoolExecutor(2) as pool:
        words = pool.submit(in_scope(lambda: [r for t in counted for r in t.collect()]))
        numbers = pool.submit(
            in_scope(lambda: counted_facts(reduce(DataFrame.unionByName, measured), list(probabilities)) if measured else {})
        )
        out = {
            names[r["id"]]: {"unique": r["unique"], "mode": r["top"]["value"], "quantiles": None} for r in words.result()
        }
        for i, facts in numbers.result().items():
            known, dtype = out.get(names[i]), types[names[i]]
            quantiles = [_scaled(x, dtype) for x in facts["quantiles"]]
            out[names[i]] = known | {"quantiles": quantiles} if known else facts | {"quantiles": quantiles}
    return {n: facts | {"mode": _mode_text(types[n], facts["mode"])} for n, facts in out.items()}


def _unscaled(text: Column, dtype: T.DecimalType) -> Column:
    """A decimal of up to 18 digits as a whole number of its last place, so that it orders alike."""
    if dtype.precision > 18:
        return F.lit(None).cast("bigint")
    return (text.cast(dtype) * F.lit(10**dtype.scale).cast("decimal(19,0)")).cast("bigint")


def _scaled(x, dtype: T.DataType):
    if isinstance(dtype, T.DecimalType) and isinstance(x, (int, Decimal)):
        return Decimal(x) / 10**dtype.scale
    return x


def _mode_text(dtype: T.DataType, mode) -> str:
    """Times come as micros or days since 1970."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        moment = datetime(1970, 1, 1) + timedelta(microseconds=int(mode))
        return moment.isoformat(" ").rstrip("0").rstrip(".") if moment.microsecond else moment.isoformat(" ")
    if isinstance(dtype, T.DateType):
        return (date(1970, 1, 1) + timedelta(days=int(mode))).isoformat()
    return str(mode)


def unique_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, unique): exact numbers of distinct non-null values."""
    parts = [
        g.table.groupBy("column_no").agg(F.count("*").alias("unique")).select(_named(g).alias("column"), "unique")
        for g in frequency_groups(df, df.columns if names is None else names)
    ]
    return reduce(DataFrame.unionByName, parts)


def modes(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, mode): the most frequent value as text, the smallest of equally frequent ones."""
    (group,) = frequency_groups(df, names, as_text=True)
    top = F.min(F.struct((-F.col("n")).alias("rank"), "value"))
    return (
        group.table.groupBy("column_no")
        .agg(top.alias("top"))
        .select(_named(group).alias("column"), F.col("top.value").alias("mode"))
    )
