"""Bounded automatic cleaning: report, apply one rule, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline import thresholds as t
from plumbline.operators.readiness import QualityReport, exit_test, quality_report
from plumbline.operators.wrangle import drop_columns, drop_duplicate_rows, impute
from plumbline.plans.per_column import together
from plumbline.session import stage

# Fixed values of the rules.
MAX_DUPLICATE_SHARE = 0.01
DROP_MISSING_SHARE = 0.6
IMPUTE_MISSING_SHARE = t.HIGH_MISSING

STEPS = "iteration int, rule string, columns string, overall_before double"


def _facts(report: QualityReport) -> tuple[float, float, bool, list]:
    """Score, duplicate share, exit and one row per column."""
    ready, columns = together(
        exit_test(report).first, report.profile.select("column", "missing_pct", "is_constant").collect
    )
    return ready["overall"], ready["duplicate_pct"], ready["is_ready"], columns


def next_rule(duplicate_pct: float, columns: list) -> tuple[str, list[str]] | None:
    """The first rule that applies, with its columns."""
    if duplicate_pct > MAX_DUPLICATE_SHARE:
        return "drop_duplicates", []
    sparse = [c["column"] for c in columns if c["missing_pct"] > DROP_MISSING_SHARE]
    if sparse:
        return "drop_sparse_columns", sparse
    constant = [c["column"] for c in columns if c["is_constant"]]
    if constant:
        return "drop_constant_columns", constant
    partial = [c["column"] for c in columns if c["missing_pct"] > IMPUTE_MISSING_SHARE]
    if partial:
        return "impute", partial
    return None


def auto_clean(df: DataFrame, max_iterations: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(cleaned, steps)`` after at most ``max_iterations`` rules.

    In order of preference: drop duplicate rows above 1 %, drop columns missing above
    60 %, drop constant columns, fill columns missing above 30 %. It stops when the frame
    passes the exit test or no rule applies. The frame is written to the shared folder
    first, and again without its duplicates, so that no round repeats what made it. Rows
    are measured again only after they have changed; dropping columns leaves the others'
    measures.
    """
    df = stage(df)
    steps, report = [], None
    for iteration in range(1, max_iterations + 1):
        report = quality_report(df) if report is None else report
        overall, duplicate_pct, is_ready, columns = _facts(report)
        rule = None if is_ready else next_rule(duplicate_pct, columns)
        if rule is None:
            break
        name, chosen = rule
        if name == "drop_duplicates":
            df, report = stage(drop_duplicate_rows(df)), None
        elif name == "impute":
            df, report = impute(df, chosen), None
        elif len(chosen) == len(df.columns):
            break  # nothing would be left
        else:
            df = drop_columns(df, chosen)
            report = report.without(chosen, df)
        steps.append((iteration, name, ", ".join(chosen), overall))
    return df, df.sparkSession.createDataFrame(steps, STEPS)
