"""Column profiles, and the facts about a table that all quality operators share.

``TableFacts`` computes each group of facts at most once, however many operators
ask for it. Every group is one job whose result has one row, or one row per
column.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablecare import fixed_values as fv
from tablecare.functions.columns import check_names, col, families, nan_as_null
from tablecare.functions.parsing import is_number
from tablecare.functions.text import strip
from tablecare.operators import frequencies
from tablecare.operators.dedupe import count_duplicates
from tablecare.sources.staging import in_scope

TABLE_SCHEMA = (
    "column STRING, dtype STRING, inferred_type STRING, total BIGINT, non_null BIGINT, "
    "null_count BIGINT, null_pct DOUBLE, `unique` BIGINT, mean DOUBLE, median DOUBLE, "
    "min DOUBLE, max DOUBLE"
)


QUARTILES = [0.25, 0.5, 0.75]


class TableFacts:
    """Facts about ``df``, computed on first use: one pass of aggregates, one table of counted
    values, one count of whole rows, and one pass over numbers for outliers. Stage ``df``
    beforehand if reading it is dear."""

    def __init__(self, df: DataFrame):
        check_names(df)
        self.df = nan_as_null(df)
        self.spark: SparkSession = df.sparkSession
        self.names: list[str] = df.columns
        self.dtypes: dict[str, str] = dict(df.dtypes)
        self.family: dict[str, str] = families(df)

    def of_family(self, *kinds: str) -> list[str]:
        return [n for n in self.names if self.family[n] in kinds]

    @cached_property
    def _counts(self) -> dict:
        """Everything that one pass without a shuffle can tell, as {fact: {column: value}}."""
        aggregates = [F.count("*").alias("rows")]
        for i, n in enumerate(self.names):
            aggregates.append(F.count(col(n)).alias(f"non_null_{i}"))
            if self.family[n] == "numeric":
                x = col(n).cast("double")
                aggregates += [
                    F.avg(x).alias(f"mean_{i}"),
                    F.min(x).alias(f"min_{i}"),
                    F.max(x).alias(f"max_{i}"),
                ]
            elif self.family[n] == "string":
                aggregates.append(F.count_if(is_number(strip(col(n)))).alias(f"numbers_{i}"))
            elif self.family[n] == "boolean":
                aggregates += [
                    F.count_if(col(n)).alias(f"true_{i}"),
                    F.count_if(~col(n)).alias(f"false_{i}"),
                ]
        row = self.df.agg(*aggregates).first().asDict()
        facts = {"rows": row.pop("rows")}
        for key, value in row.items():
            fact, i = key.rsplit("_", 1)
            facts.setdefault(fact, {})[self.names[int(i)]] = value
        return facts

    @property
    def rows(self) -> int:
        return self._counts["rows"]

    @property
    def non_null(self) -> dict[str, int]:
        return self._counts.get("non_null", {})

    @property
    def numbers(self) -> dict[str, int]:
        """Per text column: values that read as a number."""
        return self._counts.get("numbers", {})

    def nulls(self, name: str) -> int:
        return self.rows - self.non_null[name]

    def null_ratio(self, name: str) -> float:
        return self.nulls(name) / self.rows if self.rows else 0.0

    def gather(self) -> "TableFacts":
        """Take the dearest facts, counted values and copies of rows, at the same time: neither
        job needs the other, and small ones leave most of a cluster idle."""
        self._counts  # both look at these first
        with ThreadPoolExecutor(2) as pool:
            for done in [pool.submit(in_scope(getattr), self, name) for name in ("_distinct", "duplicate_rows")]:
                done.result()
        return self

    @cached_property
    def _distinct(self) -> dict[str, dict]:
        """Distinct values, mode and quartiles of every column with values, booleans apart."""
        names = [n for n in self.names if self.non_null[n] and self.family[n] != "boolean"]
        return frequencies.distinct_facts(self.df, names, QUARTILES) if names else {}

    @cached_property
    def unique(self) -> dict[str, int]:
        """Distinct non-null values per column. Booleans are known from their counts."""
        out = dict.fromkeys(self.names, 0) | {n: f["unique"] for n, f in self._distinct.items()}
        for n in self.of_family("boolean"):
            out[n] = int(self._counts["true"][n] > 0) + int(self._counts["false"][n] > 0)
        return out

    @cached_property
    def quartiles(self) -> dict[str, list[float]]:
        """[25 %, 50 %, 75 %] per numeric column that has values, as DOUBLE."""
        return {
            n: [float(x) for x in self._distinct[n]["quantiles"]] for n in self.of_family("numeric") if n in self._distinct
        }

    def exact_median(self, name: str):
        """The median of a numeric column: int or Decimal where it is known exactly."""
        return self._distinct[name]["quantiles"][1]

    def fits_double(self, name: str) -> bool:
        """Whether no value of a numeric column is changed by reading it as a DOUBLE. Decimals beyond
        2**53 in units of their last place, and whole numbers beyond 2**53, might be."""
        dtype = self.df.schema[name].dataType
        if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
            return True
        unit = 10 ** -dtype.scale if isinstance(dtype, T.DecimalType) else 1
        stats = self.stats(name)
        return not stats or max(abs(stats["min"]), abs(stats["max"])) < 2**53 * unit

    def fences(self, name: str, factor: float) -> tuple[float, float]:
        q1, _, q3 = self.quartiles[name]
        return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)

    @cached_property
    def _outliers(self) -> dict[float, dict[str, int]]:
        return {}

    def outliers(self, factor: float = fv.IQR_FACTOR) -> dict[str, int]:
        """Per numeric column: values outside the fences Q1 - f*IQR and Q3 + f*IQR."""
        if factor not in self._outliers:
            tests = {}
            for i, n in enumerate(self.quartiles):
                low, high = self.fences(n, factor)
                if not math.isnan(low + high):  # infinite quartiles leave no fence to cross
                    x = col(n).cast("double")
                    tests[n] = F.count_if((x < low) | (x > high)).alias(f"o{i}")
            row = self.df.agg(*tests.values()).first() if tests else ()
            found = dict(zip(tests, row))
            self._outliers[factor] = {n: found.get(n, 0) for n in self.quartiles}
        return self._outliers[factor]

    @cached_property
    def duplicate_rows(self) -> int:
        return count_duplicates(self.df).first()["duplicate_rows"]

    @cached_property
    def modes(self) -> dict[str, object]:
        """The mode of every boolean column, and (as text) of every text or time column
        that has both values and NULLs."""
        out: dict[str, object] = {}
        for n in self.of_family("boolean"):
            if self.non_null[n]:
                out[n] = self._counts["true"][n] > self._counts["false"][n]
        wanted = [n for n in self.of_family("string", "datetime") if self.non_null[n] and self.nulls(n)]
        return out | {n: self._distinct[n]["mode"] for n in wanted}

    def null_pct(self, name: str) -> float:
        return round(self.null_ratio(name) * 100, 2)

    def inferred_type(self, name: str) -> str:
        if not self.non_null[name]:
            return "empty"
        if self.family[name] == "numeric":
            return "numeric"
        if self.family[name] == "nested":
            return "nested"
        if self.unique[name] / self.non_null[name] > fv.IDENTIFIER_RATIO:
            return "identifier"
        return "categorical" if self.unique[name] <= fv.CATEGORICAL_MAX_UNIQUE else "freetext"

    def stats(self, name: str) -> dict[str, float]:
        """Mean, median, min and max of a numeric column with values, else nothing."""
        if name not in self.quartiles:
            return {}
        return {
            "mean": self._counts["mean"][name],
            "median": self.quartiles[name][1],
            "min": self._counts["min"][name],
            "max": self._counts["max"][name],
        }


def profile_rows(facts: TableFacts) -> list[dict]:
    return [
        {
            "column": n,
            "dtype": facts.dtypes[n],
            "inferred_type": facts.inferred_type(n),
            "total": facts.rows,
            "non_null": facts.non_null[n],
            "null_count": facts.nulls(n),
            "null_pct": facts.null_pct(n),
            "unique": facts.unique[n],
            **{k: facts.stats(n).get(k) for k in ("mean", "median", "min", "max")},
        }
        for n in facts.names
    ]


def as_facts(table) -> TableFacts:
    return table if isinstance(table, TableFacts) else TableFacts(table)


def profile_table(table: DataFrame | TableFacts) -> DataFrame:
    """One row per column: type, nulls, distinct values and numeric statistics."""
    facts = as_facts(table)
    rows = [tuple(r.values()) for r in profile_rows(facts)]
    return facts.spark.createDataFrame(rows, TABLE_SCHEMA)
