"""Column lookup and type families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """The column called exactly ``name``, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def family(dtype: T.DataType) -> str:
    """The family a column type belongs to: what statistics and fixes apply to it."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "nested"


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: family(f.dataType) for f in df.schema.fields}


def same_name(a: str, b: str) -> bool:
    """Spark resolves names without regard to case, so names are compared that way."""
    return a.lower() == b.lower()


def find_name(names, wanted: str) -> str | None:
    return next((n for n in names if same_name(n, wanted)), None)


def check_names(df: DataFrame) -> None:
    """Refuse tables whose column names Spark could not tell apart."""
    seen = set()
    for name in df.columns:
        if name.lower() in seen:
            raise ValueError(f"column name {name!r} is ambiguous: names differ by case at most")
        seen.add(name.lower())


def nan_as_null(df: DataFrame) -> DataFrame:
    """Fold floating NaN into NULL, so that every later step has one kind of missing."""
    floating = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floating else col(n)
            for n in df.columns
        ]
    )


def groupable(c: Column, dtype: T.DataType) -> Column:
    """``c`` in a form that GROUP BY accepts (maps become sorted entry arrays)."""
    if isinstance(dtype, T.MapType):
        return F.sort_array(F.map_entries(c))
    return c
