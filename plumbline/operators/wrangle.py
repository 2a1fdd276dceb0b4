"""Filter, select, mutate and fill: each gives a new frame and leaves the old one alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.columns import (
    UnknownColumn,
    col,
    families,
    family,
    is_numeric,
    number,
    numeric_columns,
    present,
    quoted,
    resolve,
    resolve_all,
)
from plumbline.plans.frequency import row_key
from plumbline.plans.ranks import column_quantiles

SYMMETRIC_SKEW = 0.5  # below this absolute skewness a column is filled with its mean


def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows that meet a Spark SQL condition, which Catalyst pushes to the scan where it can.

    As in SQL, a comparison with a missing value keeps no row, negated or not.
    :func:`compare` gives comparisons that are false for missing values instead.
    """
    return df.filter(condition)


def compare(name: str, operator: str, value: object) -> Column:
    """A comparison that is never NULL: with a missing value only ``!=`` holds.

    Combine with ``&``, ``|`` and ``~``; then ``~compare("x", ">", 3)`` keeps rows
    without an ``x``.
    """
    value = value if isinstance(value, Column) else F.lit(value)
    column = col(name)
    tests = {
        "==": column == value,
        "!=": column != value,
        "<": column < value,
        "<=": column <= value,
        ">": column > value,
        ">=": column >= value,
    }
    if operator not in tests:
        raise ValueError(f"operator must be one of {list(tests)}, not {operator!r}")
    return F.coalesce(tests[operator], F.lit(operator == "!="))


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``n_rows_before, n_rows_after, n_rows_removed``."""
    kept = after.agg(F.count(F.lit(1))).scalar()
    return before.agg(F.count(F.lit(1)).alias("n_rows_before")).select(
        "n_rows_before",
        kept.alias("n_rows_after"),
        (F.col("n_rows_before") - kept).alias("n_rows_removed"),
    )


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in the given order; names must match exactly."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise UnknownColumn(f"no columns {unknown}; the frame has {df.columns}")
    return df.select(*[col(c) for c in columns])


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    dropped = set(resolve_all(df, columns))
    return df.select(*[col(c) for c in df.columns if c not in dropped])


def mutate(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Add or replace columns in order; each Spark SQL expression sees the ones before it."""
    for name, expression in expressions.items():
        df = df.withColumn(name, F.expr(expression))
    return df


def created_columns(df: DataFrame, expressions: dict[str, str]) -> list[str]:
    """Which names :func:`mutate` would add rather than replace."""
    return [name for name in expressions if name not in df.columns]


def summary_value(df: DataFrame, column: str, how: str) -> object:
    """One summary number (or most frequent value) of a column.

    ``how`` is mean, median, mode, std, min or max. Ties for the mode go to the smallest
    value; Spark keeps the top one per task, so no group is gathered.
    """
    column = resolve(df, column)
    df = present(df).select(col(column))
    if how == "mode":
        top = (
            df.filter(col(column).isNotNull())
            .groupBy(col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.col("cnt").desc(), "value")
            .limit(1)
            .collect()
        )
        return top[0]["value"] if top else None
    if how == "median":
        row = column_quantiles(df, [number(column)], [0.5]).collect()
        return row[0]["q"][0] if row else None
    names = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "skew": "skewness"}
    if how not in names:
        raise ValueError(f"how must be median, mode or one of {list(names)}, not {how!r}")
    return df.selectExpr(f"{names[how]}({number(column)}) AS v").first()["v"]


def mutate_with_summaries(
    df: DataFrame, summaries: dict[str, tuple[str, str]], expressions: dict[str, str]
) -> DataFrame:
    """Mutate with numbers that summarise whole columns.

    ``summaries`` maps a name to ``(column, how)`` as in :func:`summary_value`; the
    expressions may use these names, which are constants of the plan, not columns of
    the result.
    """
    taken = [name for name in summaries if name in df.columns]
    if taken:
        raise ValueError(f"the frame already has columns {taken}")
    constants = {
        name: F.lit(summary_value(df, column, how)) for name, (column, how) in summaries.items()
    }
    out = present(df).select("*", *[v.alias(name) for name, v in constants.items()])
    return mutate(out, expressions).drop(*constants)


def impute_values(df: DataFrame, columns: list[str], how: str = "auto") -> dict[str, object]:
    """What :func:`impute` fills each column with: one scan for means and skewness, one plan
    for all medians, one for all modes (as texts). A column without values has none."""
    df = present(df)
    numbers = [c for c in columns if is_numeric(df, c)] if how != "mode" else []
    measured = [f"avg({number(c)}) AS m{i}" for i, c in enumerate(numbers)]
    measured += [f"skewness({number(c)}) AS s{i}" for i, c in enumerate(numbers)]
    row = df.selectExpr(*measured).first() if numbers else None
    fills: dict[str, object] = {}
    skewed = []
    for i, c in enumerate(numbers):
        skew = row[f"s{i}"]
        # The skewness of a constant is not a number; its mean is the constant.
        symmetric = skew is None or skew != skew or abs(skew) < SYMMETRIC_SKEW
        if how == "mean" or how == "auto" and symmetric:
            fills[c] = row[f"m{i}"]
        else:
            skewed.append(c)
    medians = column_quantiles(df, [number(c) for c in skewed], [0.5]).collect() if skewed else []
    fills |= {skewed[r["cid"]]: r["q"][0] for r in medians}
    return fills | _modes(df, [c for c in columns if c not in numbers])


def _modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent value of each column, as a text; of several the smallest. One scan for all columns."""
    if not columns:
        return {}
    cells = []
    for i, c in enumerate(columns):
        name, kind = quoted(c), family(df.schema[c].dataType)
        whole = f"CAST({name} AS BIGINT)" if kind == "integral" else "CAST(NULL AS BIGINT)"
        num = f"CAST({name} AS DOUBLE)" if kind in ("fractional", "decimal") else "CAST(NULL AS DOUBLE)"
        cells.append(f"{i}, {whole}, {num}, CAST({name} AS STRING)")
    values = df.selectExpr(f"stack({len(columns)}, {', '.join(cells)}) AS (cid, whole, num, txt)").filter("txt IS NOT NULL")
    counted = values.groupBy("cid", "whole", "num", "txt").agg(F.count(F.lit(1)).alias("n"))
    # Of a column one of whole and num is NULL everywhere, or both are; then texts decide.
    first = counted.groupBy("cid").agg(F.expr("min(struct(-n AS n, whole, num, txt)) AS top"))
    return {columns[r["cid"]]: r["top"]["txt"] for r in first.collect()}


def impute_value(df: DataFrame, column: str, how: str = "auto") -> object:
    """What :func:`impute` fills a column with; a mode is given as a text."""
    return impute_values(df, [resolve(df, column)], how).get(resolve(df, column))


def impute(df: DataFrame, columns: list[str], how: str = "auto") -> DataFrame:
    """Fill missing values with the column's mean, median or mode.

    ``auto`` takes the mean of a symmetric numeric column, the median of a skewed one and
    the mode of any other. A column without values stays as it is. Numeric columns filled
    with a mean or median become doubles.
    """
    df = present(df)
    columns = resolve_all(df, columns)
    if how in ("mean", "median") and len(numeric_columns(df, columns)) < len(columns):
        raise TypeError(f"{how} needs numeric columns, got {columns}")
    fills = impute_values(df, columns, how)
    out = []
    for c in df.columns:
        fill = fills.get(c)
        if fill is None:
            out.append(col(c))
        elif isinstance(fill, float) and is_numeric(df, c):
            out.append(F.coalesce(F.expr(number(c)), F.lit(fill)).alias(c))
        else:
            kind = df.schema[c].dataType
            # A time without zone must not pass through the session's zone.
            value = F.lit(str(fill)) if isinstance(kind, T.TimestampNTZType) else F.lit(fill)
            out.append(F.coalesce(col(c), value.cast(kind)).alias(c))
    return df.select(*out)


def drop_missing_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where none of the columns is missing."""
    kinds = families(df)
    tests = []
    for c in resolve_all(df, columns):
        tests.append(f"{quoted(c)} IS NOT NULL")  # on the column itself, so that the scan can use it
        if kinds[c] == "fractional":
            tests.append(f"NOT isnan({quoted(c)})")
    return present(df.filter(" AND ".join(tests)))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Each distinct row once; missing equals missing.

    Spark cannot compare maps, so a frame with maps compares the digests of its nested values.
    """
    df = present(df)
    if not any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
        return df.distinct()
    names = [f"duplicate_key_{i}" for i in range(len(df.columns))]
    keys = [f"{row_key(f)} AS {name}" for f, name in zip(df.schema.fields, names)]
    return df.selectExpr("*", *keys).dropDuplicates(names).drop(*names)
