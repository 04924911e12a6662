"""Exact quantiles, distinct counts and modes from one table of counted values.

The table (id, value, n) is dealt out by ranges of id and value and staged; equal ranges of rows
are in one partition each, so none holds more than its share however a column is spread. Sums of
``n`` by partition, one row each, tell which partition holds a wanted rank, and only those are
sorted through. It is the same for any size: one shuffle and two reads of the staged table.

Beyond 2**53 a DOUBLE can't tell whole numbers apart. So these come with ``exact``, a BIGINT that
orders alike; it decides between equal DOUBLEs, and results are made of it where it is there.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame, Window, functions as F

from tablecare.sources.staging import stage


def counted_facts(counted: DataFrame, probabilities: list[float]) -> dict[int, dict]:
    """Per id: ``unique`` (rows marked ``own``), ``mode`` (of the most frequent the smallest) and
    ``quantiles`` (linearly interpolated), from (id, value DOUBLE, exact BIGINT, n, own).

    Where values have ``exact``, modes and quantiles are exact too: int, or Decimal between two.
    """
    ranged = stage(
        counted.repartitionByRange("id", "value", "exact").withColumn("part", F.spark_partition_id()), "counted"
    )
    parts = ranged.groupBy("id", "part").agg(
        F.sum("n").alias("inside"),
        F.count_if("own").alias("unique"),
        F.min(F.struct((-F.col("n")).alias("rank"), "value", "exact")).alias("top"),
    )
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("below", F.coalesce(F.sum("inside").over(before), F.lit(0))).orderBy("id", "part").collect()
    out: dict[int, dict] = {}
    for r in rows:
        facts = out.setdefault(r["id"], {"total": 0, "unique": 0, "top": r["top"]})
        facts["total"] += r["inside"]
        facts["unique"] += r["unique"]
        facts["top"] = min(facts["top"], r["top"])
    places = {i: [p * (f["total"] - 1) for p in probabilities] for i, f in out.items()}
    ranks = {(i, k) for i, at in places.items() for x in at for k in (math.floor(x), math.ceil(x))}
    wanted = [
        (r["id"], r["part"], k, k - r["below"])
        for r in rows
        for i, k in ranks
        if i == r["id"] and r["below"] <= k < r["below"] + r["inside"]
    ]
    found = _picked(ranged, wanted) if wanted else {}

    def quantile(i: int, at: float) -> float | int | Decimal:
        low, high = found[i, math.floor(at)], found[i, math.ceil(at)]
        if low == high:
            return low
        if isinstance(low, int):
            between = low + (high - low) * Fraction(at - math.floor(at))
            return int(between) if between.denominator == 1 else Decimal(between.numerator) / between.denominator
        return low + (high - low) * (at - math.floor(at))

    def value_of(row) -> float | int:
        return row["value"] if row["exact"] is None else row["exact"]

    return {
        i: {"unique": f["unique"], "mode": value_of(f["top"]), "quantiles": [quantile(i, x) for x in places[i]]}
        for i, f in out.items()
    }


def _picked(ranged: DataFrame, wanted: list[tuple]) -> dict[tuple[int, int], float | int]:
    """The values of given ranks: (id, part, rank, rank within the part)."""
    looked_for = ranged.sparkSession.createDataFrame(wanted, "id INT, part INT, k BIGINT, inner BIGINT")
    upto = F.sum("n").over(Window.partitionBy("id", "part").orderBy("value", "exact"))
    places = (
        ranged.join(F.broadcast(looked_for.select("id", "part").distinct()), ["id", "part"], "left_semi")
        .groupBy("id", "part", "value", "exact")
        .agg(F.sum("n").alias("n"))
        .withColumn("upto", upto)
    )
    hits = places.join(F.broadcast(looked_for), ["id", "part"]).where("upto - n <= inner AND inner < upto")
    rows = hits.select("id", "k", "value", "exact").collect()
    return {(r["id"], r["k"]): r["value"] if r["exact"] is None else r["exact"] for r in rows}
