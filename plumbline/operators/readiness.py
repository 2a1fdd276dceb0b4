"""The 0-100 readiness score and the whole quality report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import thresholds as t
from plumbline.columns import present, sql_text
from plumbline.operators.outliers import (
    SUMMARY,
    counts_with_limits,
    limits_from_row,
    metadata_from_counts,
    suggested_actions,
    summary_from_measures,
)
from plumbline.operators.profile import (
    PROFILE,
    column_measures,
    duplicate_rows,
    issues_from_profile,
    profile_from_measures,
)
from plumbline.plans.per_column import pin, together

def score_from_parts(profile: DataFrame, outliers: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: the ratios, the five components, ``overall`` and ``notes``.

    ``outlier_density`` compares outliers with outliers plus one per numeric column; it
    approaches 1 quickly and is kept because the score is defined on it.
    ``outlier_share`` is the share of numeric values that are outliers.
    """
    found = outliers.selectExpr("column", "outlier_count", "n AS n_values")
    # One row per column on either side; columns that are not numeric have no outliers.
    columns = profile.join(F.broadcast(found), "column", "left").selectExpr(
        "1 AS one",
        "coalesce(avg(missing_pct), 0D) AS avg_missing",
        "coalesce(avg(CAST(is_constant AS DOUBLE)), 0D) AS constant_ratio",
        f"coalesce(avg(CAST(missing_pct > {t.READINESS_HIGH_MISSING}D AS DOUBLE)), 0D)"
        " AS high_missing_ratio",
        "coalesce(try_divide(sum(outlier_count), sum(outlier_count + 1)), 0D) AS outlier_density",
        "coalesce(try_divide(sum(outlier_count), sum(n_values)), 0D) AS outlier_share",
    )
    parts = (
        duplicates.selectExpr("1 AS one", "n_rows", "duplicate_pct")
        .join(F.broadcast(columns), "one")
        .drop("one")
    )
    ratios = {
        "missingness": "avg_missing",
        "duplicates": "duplicate_pct",
        "constants": "constant_ratio",
        "high_missing_columns": "high_missing_ratio",
        "outliers": "outlier_density",
    }
    components = [
        f"IF(n_rows > 0, round(greatest(0D, 100 - {t.READINESS_PENALTY[c]}D * {ratio}), 2), NULL)"
        f" AS {c}"
        for c, ratio in ratios.items()
    ]
    notes = [f"IF({ratio} > {limit}D, {sql_text(text)}, NULL)" for ratio, limit, text in NOTES]
    mean = f"({' + '.join(ratios)}) / {len(ratios)}"
    return parts.selectExpr("*", *components).selectExpr(
        "*",
        f"IF(n_rows > 0, greatest(0D, least(100D, round({mean}, 2))), 0D) AS overall",
        f"IF(n_rows > 0, array_compact(array({', '.join(notes)})), array('Empty dataset')) AS notes",
    )


# Ratio, limit above which the note is given, text of the note.
NOTES = [
    ("avg_missing", 0.3, "High average missingness; consider aggressive cleaning."),
    ("duplicate_pct", 0.05, "Notable duplicate rows present."),
    ("constant_ratio", 0.1, "Several constant columns provide no variance."),
    ("high_missing_ratio", 0.2, "Multiple columns with >40% missing values."),
    ("outlier_density", 0.15, "High outlier density in numeric columns."),
]


@dataclass(frozen=True)
class QualityReport:
    """What one pass of measurements left behind, and the tables that follow from it.

    ``measures`` and ``counts`` have one row per column, ``duplicates`` has one row.
    """

    measures: DataFrame
    counts: DataFrame
    duplicates: DataFrame

    def without(self, dropped: list[str], df: DataFrame) -> QualityReport:
        """The report of ``df``, which is the reported frame without some columns: only
        duplicates are measured again."""
        left = ~F.col("column").isin(dropped)
        kept = [self.measures.filter(left), self.counts.filter(left), duplicate_rows(df)]
        return QualityReport(*together(*[lambda part=part: pin(part) for part in kept]))

    @property
    def profile(self) -> DataFrame:
        return profile_from_measures(self.measures)

    @property
    def columns(self) -> DataFrame:
        """Profile, numeric summary and outliers of each column; ``position`` gives their order."""
        described = self.measures.selectExpr(*PROFILE, *SUMMARY)
        return described.join(F.broadcast(self.counts.drop("n", "method")), "column", "left")

    @property
    def outliers(self) -> DataFrame:
        return metadata_from_counts(self.counts)

    @property
    def actions(self) -> DataFrame:
        return suggested_actions(self.outliers)

    @property
    def issues(self) -> DataFrame:
        return issues_from_profile(self.profile)

    @property
    def dataset(self) -> DataFrame:
        """One row: the readiness score with its parts and notes."""
        return score_from_parts(self.profile, self.counts, self.duplicates)


def quality_report(df: DataFrame, method: str = "both", exact: bool = True) -> QualityReport:
    """Profile, outliers, duplicates and readiness of a frame.

    Each scan of the data runs once, when the report is made; what it leaves behind
    has one row per column.
    """
    df = present(df)
    measures, duplicates = together(
        lambda: column_measures(df, df.columns, exact), lambda: pin(duplicate_rows(df))
    )
    rows = summary_from_measures(measures).collect()
    limits = {row["column"]: limits_from_row(row, method) for row in rows}
    counts = pin(counts_with_limits(df, limits, method))
    return QualityReport(measures, counts, duplicates)


def readiness_score(df: DataFrame, method: str = "both", exact: bool = True) -> DataFrame:
    return quality_report(df, method, exact).dataset


def readiness_band(score: Column) -> Column:
    """The name of the band a score falls in."""
    band = F.lit(t.READINESS_LOWEST_BAND)
    for lowest, name in reversed(t.READINESS_BANDS):
        band = F.when(score >= lowest, name).otherwise(band)
    return band


def exit_test(report: QualityReport) -> DataFrame:
    """One row: score, band, and whether the frame needs no further cleaning."""
    columns = report.profile.agg(
        F.coalesce(F.max("missing_pct"), F.lit(0.0)).alias("worst_missing"),
        F.count_if("is_constant").alias("n_constant"),
    )
    one = F.lit(1).alias("one")
    joined = report.dataset.select("overall", "duplicate_pct", one).join(
        F.broadcast(columns.select("*", one)), "one"
    )
    return joined.select(
        "overall",
        readiness_band(F.col("overall")).alias("band"),
        "duplicate_pct",
        "worst_missing",
        "n_constant",
        (
            (F.col("overall") >= t.READY_SCORE)
            & (F.col("duplicate_pct") <= 0.01)
            & (F.col("worst_missing") <= t.READINESS_HIGH_MISSING)
            & (F.col("n_constant") == 0)
        ).alias("is_ready"),
    )
