"""Profiles of tables that grow: what each addition counted is stored, and only that is merged.

An addition reads its own rows once and stores one row of counts and, for each type group, how
often every value occurs. The profile of all additions comes from these parts alone: counts are
added up, values that are alike are brought together. No row of the table is read again.

When more than ``MOST`` additions have gathered, their parts are merged into one.

An addition under a name that is known already changes nothing, so what failed may be repeated.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablecare.functions.columns import check_names
from tablecare.operators import frequencies
from tablecare.operators.frequencies import FrequencyGroup
from tablecare.operators.profile import QUARTILES, TableFacts
from tablecare.sources.published import Published, Version

MOST = 16
#: Facts that are added up; of ``min`` and ``max`` the least and greatest are taken.
_SUMS = ("rows", "non_null", "numbers", "true", "false", "sum")


class ProfileState:
    """The state stored at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Published(spark, path)

    def add(self, name: str, rows: DataFrame) -> Version:
        """Take in ``rows``, an addition called ``name``."""
        if name in self.store.current().notes.get("names", ()):
            return self.store.current()
        return self._add([name], rows)

    def _add(self, added: list[str], rows: DataFrame) -> Version:
        now = self.store.current()
        check_names(rows)
        schema = rows.schema.jsonValue()
        if "schema" in now.notes and _kinds(now.notes["schema"]) != _kinds(schema):
            raise ValueError(f"the columns of {added[0]!r} are not those of the additions before")
        facts = _Counts(rows)
        folder = self.store.new_folder("part")
        groups = frequencies.frequency_groups(facts.df, facts.counted)
        for g in groups:
            g.table.write.parquet(f"{self.store.path}/{folder}/{g.carrier}")
        part = {"counts": facts.sums(), "groups": {g.carrier: list(g.names) for g in groups}}
        notes = {
            "schema": now.notes.get("schema", schema),
            "names": [*now.notes.get("names", ()), *added],
            "parts": {**now.notes.get("parts", {}), folder: part},
        }
        folders = {f: f for f in notes["parts"]}
        done = self.store.publish(folders, notes)
        return self._merged(done) if len(folders) > MOST else done

    def add_files(self, *files: str, fmt: str = "parquet", **options) -> Version:
        """Take in those of ``files`` that are not known yet, all at once; the others aren't looked at."""
        known = set(self.store.current().notes.get("names", ()))
        new = [f for f in dict.fromkeys(files) if f not in known]
        if not new:
            return self.store.current()
        return self._add(new, self.spark.read.format(fmt).options(**options).load(new))

    def facts(self) -> TableFacts:
        """What is known of all additions: profiles, issues but duplicates, outliers and advice follow from it."""
        now = self.store.current()
        if not now.number:
            raise ValueError(f"nothing has been added to {self.store.path}")
        return _StoredFacts(self.spark, self.store.path, now)

    def _merged(self, now: Version) -> Version:
        """One part instead of many."""
        facts = _StoredFacts(self.spark, self.store.path, now)
        folder = self.store.new_folder("part")
        groups = facts.groups()
        for g in groups:
            g.table.write.parquet(f"{self.store.path}/{folder}/{g.carrier}")
        part = {"counts": facts.sums, "groups": {g.carrier: list(g.names) for g in groups}}
        return self.store.publish({folder: folder}, now.notes | {"parts": {folder: part}})


def _kinds(schema: dict) -> list[tuple]:
    return [(f["name"], str(f["type"])) for f in schema["fields"]]


class _Counts(TableFacts):
    """The counts of one addition, as sums that can be merged."""

    @property
    def counted(self) -> list[str]:
        return [n for n in self.names if self.family[n] != "boolean"]

    def sums(self) -> dict:
        counts = self._counts
        means = counts.get("mean", {})
        sums = {n: None if m is None else m * counts["non_null"][n] for n, m in means.items()}
        return {k: v for k, v in counts.items() if k != "mean"} | {"sum": sums}


class _StoredFacts(TableFacts):
    """Facts from what additions have stored; the table itself is not there."""

    def __init__(self, spark: SparkSession, path: str, version: Version):
        schema = T.StructType.fromJson(version.notes["schema"])
        super().__init__(spark.createDataFrame([], schema))
        self.path, self.parts = path, version.notes["parts"]

    @cached_property
    def sums(self) -> dict:
        """The counts of all parts together."""
        out: dict = {"rows": 0}
        for part in self.parts.values():
            for fact, found in part["counts"].items():
                if fact == "rows":
                    out["rows"] += found
                    continue
                into = out.setdefault(fact, {})
                for n, x in found.items():
                    before = into.get(n)
                    if before is None or x is None:
                        into[n] = x if before is None else before
                    else:
                        into[n] = before + x if fact in _SUMS else (min if fact == "min" else max)(before, x)
        return out

    @cached_property
    def _counts(self) -> dict:
        counts = {k: v for k, v in self.sums.items() if k != "sum"}
        filled = counts.get("non_null", {})
        return counts | {"mean": {n: None if s is None else s / filled[n] for n, s in self.sums["sum"].items()}}

    def groups(self) -> list[FrequencyGroup]:
        """Counted values of all parts together."""
        found: dict[str, list[str]] = {}
        for folder, part in self.parts.items():
            for carrier in part["groups"]:
                found.setdefault(carrier, []).append(f"{self.path}/{folder}/{carrier}")
        names = {carrier: tuple(x) for part in self.parts.values() for carrier, x in part["groups"].items()}
        out = []
        for carrier, folders in found.items():
            schema = f"column_no int, value {carrier}, n long"
            table = self.spark.read.schema(schema).parquet(*folders)
            if len(folders) > 1:
                table = table.groupBy("column_no", "value").agg(F.sum("n").alias("n"))
            out.append(FrequencyGroup(carrier, names[carrier], table))
        return out

    @cached_property
    def _distinct(self) -> dict[str, dict]:
        names = [n for n in self.names if self.family[n] != "boolean"]
        if not any(self.non_null[n] for n in names):
            return {}
        return frequencies.facts_of_groups(self.groups(), self.df.schema, names, QUARTILES)

    def outliers(self, factor: float | None = None) -> dict[str, int]:
        """From counted values."""
        factor = factor if factor is not None else TableFacts.outliers.__defaults__[0]
        out = dict.fromkeys(self.quartiles, 0)
        for g in self.groups():
            tests = []
            for i, n in enumerate(g.names):
                if n in out and not any(x != x or abs(x) == float("inf") for x in self.quartiles[n]):
                    low, high = self.fences(n, factor)
                    x = F.col("value").cast("double")
                    tests.append((F.col("column_no") == i) & ((x < low) | (x > high)))
            if tests:
                found = g.table.where(reduce(lambda a, b: a | b, tests)).groupBy("column_no").agg(F.sum("n").alias("n"))
                out.update((g.names[r["column_no"]], r["n"]) for r in found.collect())
        return out

    @property
    def duplicate_rows(self) -> int:
        raise ValueError("stored counts know values, not whole rows: ask the table itself for duplicates")
