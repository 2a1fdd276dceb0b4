"""Numeric summaries, outliers by fences or z-scores, and what to do about them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import thresholds as t
from plumbline.columns import (
    INTEGRAL,
    col,
    number,
    numeric_columns,
    present,
    quoted,
    require_numeric,
    resolve,
    sql_double,
    sql_text,
)
from plumbline.functions.text import four_digits, percent
from plumbline.operators.profile import column_measures
from plumbline.plans.per_column import wide_to_long

METHODS = ("iqr", "zscore", "both")


def _check(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    return method


def numeric_summary(
    df: DataFrame, columns: list[str] | None = None, exact: bool = True
) -> DataFrame:
    """``column, n, n_missing, mean, std, min, q1, median, q3, max, iqr`` per numeric column.

    Moments come from one scan; quartiles from the value frequencies, ranked in slices
    when the frame is large. ``exact=False`` takes approximate quartiles from sketches.
    """
    df = present(df)
    return summary_from_measures(column_measures(df, numeric_columns(df, columns), exact))


# The numeric summary of a column from its measures.
SUMMARY = [
    "mean", "std", "min", "q[0] AS q1", "q[1] AS median", "q[2] AS q3", "max", "q[2] - q[0] AS iqr",
]


def summary_from_measures(measures: DataFrame) -> DataFrame:
    numeric = measures.filter("family IN ('integral', 'fractional', 'decimal')")
    return numeric.selectExpr("column", "n_rows - n_missing AS n", "n_missing", *SUMMARY)


@dataclass(frozen=True)
class Limits:
    """What decides whether a value of one column is an outlier."""

    lower: float | None
    upper: float | None
    mean: float | None
    std: float | None

    def flag(self, value: str) -> str:
        """SQL that is true for outliers, false for other values and for missing ones."""
        return f"coalesce({self.test(value)}, false)"

    def test(self, value: str) -> str:
        """SQL that is true for outliers, and false or NULL for other values."""
        tests = []
        if self.lower is not None:
            tests += [f"{value} < {sql_double(self.lower)}", f"{value} > {sql_double(self.upper)}"]
        if self.std is not None and self.std > 0:
            score = f"({value} - {sql_double(self.mean)}) / {sql_double(self.std)}"
            tests.append(f"abs({score}) > {t.Z_LIMIT}D")
        return f"({' OR '.join(tests)})" if tests else "false"


def limits_from_row(row: Row, method: str) -> Limits:
    fences = method in ("iqr", "both") and row["q1"] is not None
    scores = method in ("zscore", "both")
    return Limits(
        lower=row["q1"] - t.IQR_FENCE * row["iqr"] if fences else None,
        upper=row["q3"] + t.IQR_FENCE * row["iqr"] if fences else None,
        mean=row["mean"] if scores else None,
        std=row["std"] if scores else None,
    )


def column_limits(
    df: DataFrame, columns: list[str] | None = None, method: str = "both", exact: bool = True
) -> dict[str, Limits]:
    """The limits of each numeric column. Runs one job; only one row per column comes back."""
    _check(method)
    rows = numeric_summary(df, columns, exact).collect()
    return {row["column"]: limits_from_row(row, method) for row in rows}


def counts_with_limits(df: DataFrame, limits: dict[str, Limits], method: str) -> DataFrame:
    df = present(df)
    columns = list(limits)
    values = [number(c) for c in columns]
    flags = [limits[c].flag(v) for c, v in zip(columns, values)]
    # One scan of conditional counts; no row leaves its task.
    long = wide_to_long(
        df,
        columns,
        {
            "n": [f"count({v})" for v in values],
            "outlier_count": [f"count_if({f})" for f in flags],
            "min_outlier": [f"min(IF({f}, {v}, NULL))" for f, v in zip(flags, values)],
            "max_outlier": [f"max(IF({f}, {v}, NULL))" for f, v in zip(flags, values)],
            "lower_bound": [f"max({sql_double(limits[c].lower)})" for c in columns],
            "upper_bound": [f"max({sql_double(limits[c].upper)})" for c in columns],
        },
    )
    return long.selectExpr(
        "column",
        "n",
        "outlier_count",
        "outlier_count / greatest(1, n) AS outlier_pct",
        f"'{method}' AS method",
        "lower_bound",
        "upper_bound",
        "min_outlier",
        "max_outlier",
    )


def outlier_counts(
    df: DataFrame, columns: list[str] | None = None, method: str = "both", exact: bool = True
) -> DataFrame:
    """Outlier count, share, bounds and extremes of every numeric column.

    Bounds are those of the fences; with ``zscore`` there are none.
    """
    return counts_with_limits(df, column_limits(df, columns, method, exact), method)


def outlier_rows(df: DataFrame, column: str, method: str = "both") -> DataFrame:
    """All rows whose value in ``column`` is an outlier."""
    column = require_numeric(df, column)
    limits = column_limits(df, [column], method)[column]
    value = raw_number(df, column)
    # On the column itself, so that the scan can use it; NaN is larger than any number.
    return present(df.filter(f"{limits.test(value)} AND NOT isnan({value})"))


def outlier_preview(
    df: DataFrame, column: str, key: str, method: str = "both", n: int = t.PREVIEW_OUTLIERS
) -> DataFrame:
    """The ``n`` smallest outliers by value, then key, with the total and whether more exist."""
    rows = outlier_rows(df, column, method)
    value, key = resolve(df, column), resolve(df, key)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return (
        rows.select(col(key).alias("key"), col(value).cast("double").alias("value"))
        .orderBy("value", "key")
        .limit(n)
        .select("key", "value", total.alias("outlier_count"), (total > n).alias("truncated"))
    )


def metadata_from_counts(counts: DataFrame) -> DataFrame:
    """Columns that have outliers, with a filter text that keeps what lies inside the bounds."""
    hint = (
        f"concat_ws(' and ', concat('`', column, '` >= ', {four_digits('lower_bound')}),"
        f" concat('`', column, '` <= ', {four_digits('upper_bound')}))"
    )
    return counts.filter("outlier_count > 0").selectExpr("*", f"{hint} AS suggested_filter")


def outlier_metadata(
    df: DataFrame, columns: list[str] | None = None, method: str = "both"
) -> DataFrame:
    return metadata_from_counts(outlier_counts(df, columns, method))


def suggested_actions(metadata: DataFrame) -> DataFrame:
    """``column, action`` for each column of :func:`outlier_metadata`."""
    # The texts of the actions.
    lower = f"coalesce({four_digits('lower_bound')}, '-inf')"
    upper = f"coalesce({four_digits('upper_bound')}, 'inf')"
    return metadata.selectExpr(
        "column",
        f"IF(outlier_pct > {t.HIGH_OUTLIER_SHARE}D,"
        f" concat('High outlier rate (', {percent('outlier_pct')}, ') in \\'', column,"
        f" '\\': Consider removing values outside [', {lower}, ', ', {upper}, ']'),"
        " concat('Found ', outlier_count, ' outliers in \\'', column,"
        " '\\': Filter: ', suggested_filter)) AS action",
    )


def outlier_options(metadata: DataFrame) -> DataFrame:
    """What can be removed: everything, or one column at a time.

    ``id, description, estimated_rows, lower_bound, upper_bound``; empty when no column
    has outliers. The rows removed by "all" depend on overlap and are left NULL.
    """
    # The texts of the options.
    bounds = (
        f"coalesce(concat('keep values in [', {four_digits('lower_bound')}, ', ',"
        f" {four_digits('upper_bound')}, ']'), '')"
    )
    single = metadata.selectExpr(
        "column AS id",
        f"concat('Remove ', outlier_count, ' outliers from \\'', column, '\\' (',"
        f" {percent('outlier_pct')}, ' of values) - ', {bounds}) AS description",
        "outlier_count AS estimated_rows",
        "lower_bound",
        "upper_bound",
    )
    everything = metadata.selectExpr("sum(outlier_count) AS total").filter("total IS NOT NULL")
    everything = everything.selectExpr(
        "'all' AS id",
        "concat('Remove ALL outliers (', total, ' total across all columns)') AS description",
        "CAST(NULL AS BIGINT) AS estimated_rows",
        "CAST(NULL AS DOUBLE) AS lower_bound",
        "CAST(NULL AS DOUBLE) AS upper_bound",
    )
    return everything.unionByName(single)


def raw_number(df: DataFrame, column: str) -> str:
    """SQL for the column as a double; a double column stands for itself."""
    return quoted(column) if df.schema[column].dataType.simpleString() == "double" else number(column)


def _chosen_bounds(
    df: DataFrame, metadata: DataFrame, columns: list[str] | None
) -> list[tuple[str, float | None, float | None]]:
    """The stored bounds to apply; one row per column reaches the driver.

    A name that the frame lacks is an error; a column without stored bounds is left alone.
    """
    wanted = None if columns is None else {resolve(df, c).lower() for c in columns}
    bounds = []
    for row in metadata.select("column", "lower_bound", "upper_bound").collect():
        if wanted is not None and row["column"].lower() not in wanted:
            continue
        if row["column"] not in df.columns:
            continue
        if row["lower_bound"] is None and row["upper_bound"] is None:
            continue
        bounds.append((row["column"], row["lower_bound"], row["upper_bound"]))
    return bounds


def remove_outliers(
    df: DataFrame, metadata: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Rows inside the stored bounds of every chosen column; a missing value there drops the row.

    Without bounds (no outliers, no matching column, z-scores only) the frame is unchanged.
    """
    tests = []
    for column, lower, upper in _chosen_bounds(df, metadata, columns):
        value = raw_number(df, column)
        tests.append(f"NOT isnan({value})")
        if lower is not None:
            tests.append(f"{value} >= {sql_double(lower)}")
        if upper is not None:
            tests.append(f"{value} <= {sql_double(upper)}")
    return present(df.filter(" AND ".join(tests)) if tests else df)


def removal_report(df: DataFrame, metadata: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, n_rows, n_outside, filter, message``: what :func:`remove_outliers` does.

    One row per column that it filters by, and a last one without a column for all
    together, whose ``n_outside`` is the number of rows removed. Without bounds to apply
    that row alone says so. Rows with a missing value count as outside.
    """
    bounds = _chosen_bounds(df, metadata, columns)
    tests = []
    for column, lower, upper in bounds:
        value = raw_number(df, column)
        parts = [f"NOT isnan({value})"]
        parts += [f"{value} >= {sql_double(lower)}"] if lower is not None else []
        parts += [f"{value} <= {sql_double(upper)}"] if upper is not None else []
        tests.append(f"coalesce({' AND '.join(parts)}, false)")
    hints = [
        " and ".join(
            [f"`{c}` >= {lower:.4f}"] * (lower is not None) + [f"`{c}` <= {upper:.4f}"] * (upper is not None)
        )
        for c, lower, upper in bounds
    ]
    every = " AND ".join(tests) or "true"
    counts = [f"count_if(NOT ({test})) AS c{i}" for i, test in enumerate([*tests, every])]
    wide = df.selectExpr("count(*) AS n_rows", *counts)
    message = "'Outliers removed'" if bounds else "'No outliers to remove'"
    cells = [
        f"{sql_text(c)}, c{i}, {sql_text(hint)}, CAST(NULL AS STRING)"
        for i, ((c, _, _), hint) in enumerate(zip(bounds, hints, strict=True))
    ]
    cells.append(f"CAST(NULL AS STRING), c{len(tests)}, {sql_text(' and '.join(hints))}, {message}")
    long = wide.selectExpr("n_rows", f"stack({len(cells)}, {', '.join(cells)}) AS (column, n_outside, filter, message)")
    return long.select("column", "n_rows", "n_outside", "filter", "message")


def clip_outliers(
    df: DataFrame, metadata: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Values outside the stored bounds moved to the nearest bound; missing ones stay missing.

    Integer and decimal columns keep their type if their bounds are whole; else they become doubles.
    """
    df = present(df)
    for column, lower, upper in _chosen_bounds(df, metadata, columns):
        kind = df.schema[column].dataType
        # A whole bound fits a whole column; then values inside keep all their digits.
        fits = isinstance(kind, INTEGRAL + (T.DecimalType,)) and all(
            b is None or float(b).is_integer() for b in (lower, upper)
        )
        shown = (lambda x: f"CAST({x} AS {kind.simpleString()})") if fits else (lambda x: x)  # noqa: B023
        cases = ""
        if lower is not None:
            cases += f" WHEN {number(column)} < {sql_double(lower)} THEN {shown(sql_double(lower))}"
        if upper is not None:
            cases += f" WHEN {number(column)} > {sql_double(upper)} THEN {shown(sql_double(upper))}"
        inside = quoted(column) if fits else number(column)
        df = df.withColumn(column, F.expr(f"CASE{cases} ELSE {inside} END"))
    return df


def comparison_candidates(counts: DataFrame) -> DataFrame:
    """Columns whose outlier share is high enough to show them with and without outliers."""
    return counts.filter(F.col("outlier_pct") > t.COMPARE_OUTLIER_SHARE).select(
        "column", "outlier_count", "outlier_pct"
    )


def outlier_profile(
    df: DataFrame, column: str, measures: list[str] | None = None, method: str = "both"
) -> DataFrame:
    """How flagged rows differ: per flag the row count and the mean of each numeric column."""
    column = require_numeric(df, column)
    limits = column_limits(df, [column], method)[column]
    df = present(df)
    return (
        df.filter(col(column).isNotNull())
        .groupBy(F.expr(limits.flag(number(column))).alias("is_outlier"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.expr(f"avg({number(c)})").alias(f"mean_{c}") for c in numeric_columns(df, measures)],
        )
    )
