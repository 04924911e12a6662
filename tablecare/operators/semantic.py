"""What each column of a table means, judged by its values and its header.

One distributed aggregate counts, for every text column, how many values each
detector accepts. Its result has one row per column, so the choice of a type is
made on the driver.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecare import fixed_values as fv
from tablecare.config import SemanticConfig, settings
from tablecare.functions.columns import check_names, col, families, family
from tablecare.functions.detectors import TESTS
from tablecare.functions.text import strip

PROFILE_SCHEMA = (
    "column STRING, semantic_type STRING, confidence DOUBLE, reason STRING, "
    "header_matched BOOLEAN, sample_size BIGINT, match_count BIGINT, detector STRING"
)


@dataclass(frozen=True)
class ColumnMeaning:
    column: str
    semantic_type: str
    confidence: float = 0.0
    reason: str = ""
    header_matched: bool = False
    sample_size: int = 0
    match_count: int = 0
    detector: str = "none"


@dataclass(frozen=True)
class SemanticProfile:
    columns: dict[str, ColumnMeaning]

    @property
    def summary(self) -> dict[str, list[str]]:
        """Semantic type -> its columns, in table order."""
        out: dict[str, list[str]] = {}
        for name, meaning in self.columns.items():
            out.setdefault(meaning.semantic_type, []).append(name)
        return out

    @property
    def types_detected(self) -> int:
        return sum(1 for t in self.summary if t != fv.UNKNOWN)

    def of_type(self, *semantic_types: str) -> list[str]:
        return [n for n, m in self.columns.items() if m.semantic_type in semantic_types]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(asdict(m).values()) for m in self.columns.values()]
        return spark.createDataFrame(rows, PROFILE_SCHEMA)

    def summary_df(self, spark: SparkSession) -> DataFrame:
        return (
            self.to_df(spark)
            .groupBy("semantic_type")
            .agg(
                F.array_sort(F.collect_list("column")).alias("columns"),
                F.count("*").alias("n_columns"),
            )
        )

    @staticmethod
    def of(types: dict[str, str]) -> "SemanticProfile":
        """A profile stated by hand: column name -> semantic type."""
        return SemanticProfile(
            {n: ColumnMeaning(n, t, 1.0, "given", detector="given") for n, t in types.items()}
        )


def detector_counts(text: Column, lower: Column, prefix: str = "") -> list[Column]:
    """Aggregates over stripped text and its lower-case form: how many values are not blank,
    and how many each detector accepts."""
    return [F.count_if(text != "").alias(f"{prefix}n_values")] + [
        F.count_if(test(text, lower)).alias(f"{prefix}n_{name}") for name, test in TESTS.items()
    ]


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, kind in families(df).items() if kind == "string"]


def melt(df: DataFrame, names: list[str], *extra: Column) -> DataFrame:
    """Rows of (column_no, value): one per cell of the named columns."""
    cells = [c for i, n in enumerate(names) for c in (F.lit(i), col(n))]
    return df.select(*extra, F.stack(F.lit(len(names)), *cells).alias("column_no", "value"))


def match_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per text column: cells, non-blank values and accepted values per detector.

    The table is melted before it is aggregated, so the plan stays the same
    size however many columns there are; only one row per column and task is
    shuffled.
    """
    names = text_columns(df) if names is None else names
    labels = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    return (
        melt(df, names).withColumn("text", strip(F.col("value")))
        .withColumn("lower", F.lower("text"))
        .groupBy("column_no")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(F.col("value") != F.col("text")).alias("n_untrimmed"),
            *detector_counts(F.col("text"), F.col("lower")),
        )
        .withColumn("column", labels[F.col("column_no")])
    )


def semantic_profile(df: DataFrame, config=None, row_id: str | None = None) -> SemanticProfile:
    """Classify every column of ``df``; runs one aggregate job."""
    check_names(df)
    cfg = settings(SemanticConfig, config)
    names = [n for n in text_columns(df) if n != row_id]
    counts = {}
    if names:
        counts = {r["column"]: r.asDict() for r in match_counts(df, names).collect()}
    return profile_from_counts(df, counts, cfg, skip=row_id)


def profile_from_counts(
    df: DataFrame, counts: dict[str, dict], cfg: SemanticConfig, skip: str | None = None
) -> SemanticProfile:
    meanings = {}
    for f in df.schema.fields:
        if f.name == skip:
            continue
        if family(f.dataType) != "string":
            meanings[f.name] = ColumnMeaning(
                f.name,
                fv.UNKNOWN,
                reason=f"column dtype is {f.dataType.simpleString()}; skipped semantic detection",
            )
        else:
            meanings[f.name] = choose_type(f.name, counts.get(f.name, {"n_values": 0}), cfg)
    return SemanticProfile(meanings)


def header_matches(name: str, semantic_type: str) -> bool:
    header = name.strip().lower().replace(" ", "_")
    return header in fv.HEADER_ALIASES.get(semantic_type, ())


def confidence(hits: int, values: int, hinted: bool, cfg: SemanticConfig) -> float:
    """Share of accepted values, lifted by a fitting header; rounded before it is compared."""
    return round(min(1.0, hits / values + (cfg.header_boost if hinted else 0.0)), 2)


def choose_type(name: str, counts: dict, cfg: SemanticConfig) -> ColumnMeaning:
    """The best-scoring type of one column, or ``unknown`` when none is sure enough.

    ``max`` keeps the first of equals, so ties go to the earlier detector.
    """
    n = counts["n_values"]
    if n < cfg.min_non_null_for_detection:
        return ColumnMeaning(
            name,
            fv.UNKNOWN,
            reason=f"only {n} non-null values; below minimum threshold of "
            f"{cfg.min_non_null_for_detection}",
            sample_size=n,
        )
    single = "last_name" if header_matches(name, "last_name") else "first_name"
    scored = []
    for detector in TESTS:
        kind = single if detector == "single_name" else detector
        hits, hinted = counts[f"n_{detector}"], header_matches(name, kind)
        scored.append(
            ColumnMeaning(
                name,
                kind,
                confidence(hits, n, hinted, cfg),
                f"{hits}/{n} sampled values matched {kind} pattern"
                + ("; header boost applied" if hinted else ""),
                hinted,
                n,
                hits,
                "regex_v1",
            )
        )
    best = max(scored, key=lambda m: m.confidence)
    if best.confidence >= cfg.confidence_threshold:
        return best
    return replace(
        best,
        semantic_type=fv.UNKNOWN,
        reason=f"no detector exceeded confidence threshold of {cfg.confidence_threshold:.2f}",
        header_matched=any(m.header_matched for m in scored),
        detector="none",
    )
