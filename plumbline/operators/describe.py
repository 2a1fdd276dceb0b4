"""Univariate, bivariate, contingency and correlation summaries as long tables."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import thresholds as t
from plumbline.columns import (
    col,
    is_numeric,
    number,
    numeric_columns,
    present,
    quoted,
    require_numeric,
    resolve,
    resolve_all,
    sql_double,
    sql_text,
)
from plumbline.operators.outliers import (
    SUMMARY,
    counts_with_limits,
    limits_from_row,
    summary_from_measures,
)
from plumbline.operators.profile import column_measures, distinct_of
from plumbline.plans.frequency import NUMERIC_VALUE, countable, text_key, value_frequencies
from plumbline.plans.gram import pair_sums
from plumbline.plans.per_column import pin, wide_to_long
from plumbline.plans.ranks import group_quantiles

GRID_PIECES = 64  # tasks that pair the levels of a contingency table
PAIRS_PER_SCAN = 100  # keeps the generated code of one aggregate within what the JVM compiles


# ---- one column -------------------------------------------------------------


def _most_frequent(freq: DataFrame, columns: list[str]) -> DataFrame:
    """``cid, column, value, exact, cnt``: every value that reaches the highest count of its column.

    ``exact`` is the value as a text, which keeps integers and decimals beyond a double's digits.
    """
    exact = "coalesce(CAST(whole AS STRING), txt, CAST(num AS STRING)) AS exact"
    freq = freq.selectExpr("cid", f"{NUMERIC_VALUE} AS value", exact, "cnt").filter("value IS NOT NULL")
    highest = freq.groupBy("cid").agg(F.max("cnt").alias("cnt"))
    # One row per column on the broadcast side.
    ties = freq.join(F.broadcast(highest), ["cid", "cnt"])
    names = ", ".join(sql_text(c) for c in columns)
    return ties.selectExpr("cid", f"array({names})[cid] AS column", "value", "exact", "cnt")


def mode_ties(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, cnt``: all modes of the numeric columns.

    A column of distinct values has every value as a mode, so this may be as long as the
    frame; it stays distributed.
    """
    df = present(df)
    columns = numeric_columns(df, columns)
    return _most_frequent(value_frequencies(df, columns), columns).drop("cid", "exact")


def univariate_numeric(
    df: DataFrame, columns: list[str] | None = None, method: str = "both"
) -> DataFrame:
    """Location, spread, modes and outliers of each numeric column.

    ``mode`` is the smallest mode, ``mode_text`` the same with all its digits, and
    ``mode_tie_count`` how many there are; see :func:`mode_ties` for all of them.
    """
    df = present(df)
    columns = numeric_columns(df, columns)
    if not columns:
        raise ValueError("no numeric columns to summarise")
    df = df.select(*[col(c) for c in columns])
    freq = value_frequencies(df, countable(df, columns))
    first = F.min(F.struct("value", F.expr("CAST(exact AS DECIMAL(38, 10)) AS digits"), "exact")).alias("first")
    modes = (
        _most_frequent(freq, columns)
        .groupBy("cid")
        .agg(first, F.count(F.lit(1)).alias("mode_tie_count"), F.max("cnt").alias("mode_count"))
        .select("cid", F.col("first.value").alias("mode"), F.col("first.exact").alias("mode_text"), "mode_tie_count", "mode_count")
    )
    # One plan, in which the shuffled frequencies are used for distinct counts and modes.
    counted = distinct_of(freq).join(F.broadcast(modes), "cid", "left")
    measures = column_measures(df, columns, True, counted)
    rows = summary_from_measures(measures).collect()
    limits = {row["column"]: limits_from_row(row, method) for row in rows}
    counts = pin(counts_with_limits(df, limits, method))
    described = measures.selectExpr(
        "column", "n_rows AS n", "n_missing", "n_missing / greatest(1, n_rows) AS missing_pct",
        "mode", "mode_text", "mode_tie_count", "mode_count", *SUMMARY,
    )
    found = counts.selectExpr("column", "IF(n = 0, NULL, outlier_count) AS n_outliers")
    return described.join(F.broadcast(found), "column", "left")


def category_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, is_missing, count, share`` for every value of each non-numeric column.

    Shares are of all rows, missing ones included. Values are texts.
    """
    df = present(df)
    if columns is None:
        columns = [c for c in df.columns if not is_numeric(df, c)]
    columns = resolve_all(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, is_missing boolean, count bigint, share double"
        )
    cells = ", ".join(f"{sql_text(c)}, CAST({quoted(c)} AS STRING)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {cells}) AS (column, value)")
    # Values are told apart by a key of bounded width; each carries one copy of its text.
    counted = (
        long.groupBy("column", F.expr(text_key("value")).alias("key"))
        .agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("count"))
        .drop("key")
    )
    rows = df.agg(F.count(F.lit(1))).scalar()
    return counted.select(
        "column", "value", F.col("value").isNull().alias("is_missing"), "count",
        (F.col("count") / rows).alias("share"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, is_missing, count, share`` of one column, most frequent first."""
    column = resolve(df, column)
    return category_counts(df, [column]).drop("column").orderBy(F.col("count").desc(), "value")


def univariate_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per non-numeric column: counts, the smallest mode and how many modes tie."""
    counts = category_counts(df, columns)
    per_column = counts.groupBy("column").agg(
        F.sum("count").alias("n"),
        F.expr("coalesce(sum(count) FILTER (WHERE is_missing), 0L)").alias("n_missing"),
        F.expr("count_if(NOT is_missing)").alias("n_unique"),
        F.expr("max(count) FILTER (WHERE NOT is_missing)").alias("mode_count"),
    )
    modes = (
        counts.filter("NOT is_missing")
        .join(F.broadcast(per_column.select("column", "mode_count")), "column")
        .filter("count = mode_count")
        .groupBy("column")
        .agg(F.min("value").alias("mode"), F.count(F.lit(1)).alias("mode_tie_count"))
    )
    return per_column.join(F.broadcast(modes), "column", "left").selectExpr(
        "column", "n", "n_missing", "n_missing / greatest(1, n) AS missing_pct",
        "n_unique", "mode", "mode_count", "mode_tie_count",
    )


def univariate(df: DataFrame, columns: list[str] | None = None, method: str = "both") -> DataFrame:
    """One row per column of any type: ``column, kind`` and what fits its kind.

    ``kind`` is numeric or categorical. Both have ``n, n_missing, missing_pct, mode,
    mode_count, mode_tie_count`` (the mode as a text); numeric columns add location,
    spread and outliers, others the number of values. What does not fit is NULL.
    """
    columns = resolve_all(df, columns)
    numeric = [c for c in columns if is_numeric(df, c)]
    parts = []
    if numeric:
        found = univariate_numeric(df, numeric, method).drop("mode").withColumnRenamed("mode_text", "mode")
        parts.append(found.withColumn("kind", F.lit("numeric")))
    if len(numeric) < len(columns):
        found = univariate_categorical(df, [c for c in columns if c not in numeric])
        parts.append(found.withColumn("kind", F.lit("categorical")))
    if not parts:
        raise ValueError("no columns to summarise")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    shared = ["column", "kind", "n", "n_missing", "missing_pct", "mode", "mode_count", "mode_tie_count"]
    own = {
        "n_unique": "bigint", "mean": "double", "std": "double", "min": "double", "q1": "double",
        "median": "double", "q3": "double", "max": "double", "iqr": "double", "n_outliers": "bigint",
    }
    return out.select(
        *shared, *[F.col(c) if c in out.columns else F.lit(None).cast(t).alias(c) for c, t in own.items()]
    )


# ---- two columns ------------------------------------------------------------


def _pair(x: str, y: str) -> tuple[str, str, str]:
    """SQL aggregates over the rows where both are present: count, covariance, correlation.

    The correlation of a constant column is NULL; so are both measures with an infinite value.
    """
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    cov = f"covar_samp({x}, {y})"
    sd_x = f"stddev_samp({x}) FILTER (WHERE {y} IS NOT NULL)"
    sd_y = f"stddev_samp({y}) FILTER (WHERE {x} IS NOT NULL)"
    # NaN, from infinities, counts as missing.
    known = "nanvl({}, CAST(NULL AS DOUBLE))".format
    return f"count_if({both})", known(cov), known(f"try_divide({cov}, {sd_x} * {sd_y})")


def bivariate_numeric(df: DataFrame, x: str, y: str) -> DataFrame:
    """``x, y, n_complete, correlation, covariance`` over rows complete in both."""
    df = present(df)
    x, y = require_numeric(df, x), require_numeric(df, y)
    n, cov, corr = _pair(number(x), number(y))
    return df.selectExpr(
        f"{n} AS n_complete", f"{cov} AS covariance", f"{corr} AS correlation"
    ).selectExpr(
        f"{sql_text(x)} AS x", f"{sql_text(y)} AS y", "n_complete", "correlation", "covariance"
    )


def group_summary(df: DataFrame, numeric: str, category: str) -> DataFrame:
    """Per category: count, mean, median, std, min, max of the numeric column.

    Rows without a category are left out; a category without numbers stays, with count 0.
    """
    df = present(df)
    numeric, category = require_numeric(df, numeric), resolve(df, category)
    rows = df.selectExpr(f"{quoted(category)} AS category", f"{number(numeric)} AS value")
    rows = rows.filter("category IS NOT NULL")
    measures = [
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    names = ["category", "count", "mean", "median", "std", "min", "max"]
    medians = group_quantiles(rows, ["category"], "value", [0.5])
    medians = medians.selectExpr("category", "q[0] AS median")
    return rows.groupBy("category").agg(*measures).join(medians, "category", "left").select(*names)


def contingency_cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """``x, y, count`` of the combinations that occur; a missing value is a level of its own."""
    df = present(df)
    x, y = resolve(df, x), resolve(df, y)
    return df.groupBy(col(x).alias("x"), col(y).alias("y")).agg(
        F.count(F.lit(1)).alias("count")
    )


def contingency_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """``x, y, count`` of every combination of levels, zeros included.

    The table is as large as the product of both numbers of levels, whatever they are;
    :func:`contingency_cells` holds the same without its zeros. Cells are counted first,
    so only levels are paired: those of ``x`` are dealt over pieces, those of ``y`` go to each.
    """
    cells = contingency_cells(df, x, y)
    piece = F.pmod(F.xxhash64("x"), F.lit(GRID_PIECES)).alias("piece")
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID_PIECES - 1).cast("long"))).alias("piece")
    levels = cells.select("x").distinct().select("x", piece)
    grid = levels.join(cells.select("y").distinct().select("y", pieces), "piece").select("x", "y")
    found = cells.withColumnsRenamed({"x": "cx", "y": "cy"})
    same = F.col("x").eqNullSafe(F.col("cx")) & F.col("y").eqNullSafe(F.col("cy"))
    return grid.join(found, same, "left").select(
        "x", "y", F.coalesce("count", F.lit(0).cast("long")).alias("count")
    )


def _contingency(df: DataFrame, x: str, y: str, zeros: bool) -> DataFrame:
    return contingency_counts(df, x, y) if zeros else contingency_cells(df, x, y)


def contingency_proportions(df: DataFrame, x: str, y: str, zeros: bool = True) -> DataFrame:
    """``x, y, proportion`` of all rows; without ``zeros``, of the combinations that occur."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    counts = _contingency(df, x, y, zeros)
    return counts.select("x", "y", (F.col("count") / rows).alias("proportion"))


def contingency_expected(df: DataFrame, x: str, y: str, zeros: bool = True) -> DataFrame:
    """``x, y, count, expected``: row total times column total over all rows.

    The margins are sums over the cells that occur.
    """
    cells = contingency_cells(df, x, y)
    counts = _contingency(df, x, y, zeros)
    row_sums = cells.groupBy(F.col("x").alias("rx")).agg(F.sum("count").alias("row_sum"))
    col_sums = cells.groupBy(F.col("y").alias("cy")).agg(F.sum("count").alias("col_sum"))
    rows = df.agg(F.count(F.lit(1))).scalar()
    return (
        counts.join(row_sums, F.col("x").eqNullSafe(F.col("rx")))
        .join(col_sums, F.col("y").eqNullSafe(F.col("cy")))
        .select("x", "y", "count", (F.col("row_sum") * F.col("col_sum") / rows).alias("expected"))
    )


def bivariate(df: DataFrame, x: str, y: str) -> DataFrame:
    """The summary that fits the types of the two columns."""
    x, y = resolve(df, x), resolve(df, y)
    if is_numeric(df, x) and is_numeric(df, y):
        return bivariate_numeric(df, x, y)
    if is_numeric(df, x):
        return group_summary(df, x, y)
    if is_numeric(df, y):
        return group_summary(df, y, x)
    return contingency_expected(df, x, y, zeros=False)


# ---- many columns -----------------------------------------------------------


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``col_a, col_b, n_complete, correlation`` of each pair, ``col_a`` before ``col_b``.

    Each pair uses the rows complete in it; a column that is constant there gives NULL.
    A first scan finds mean, range and missing values of each column. A second sums
    products of deviations from the means: one sum per pair of columns without missing
    values, a few conditional ones for any other pair. Neither moves rows. More than
    ``PAIRS_PER_SCAN`` pairs are summed as products of blocks of rows (:mod:`plumbline.plans.gram`),
    in one scan for up to ``gram.PANEL`` columns; that needs numpy and pyarrow.
    """
    df = present(df)
    columns = numeric_columns(df, columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        raise ValueError("a correlation needs two numeric columns")
    first = df.selectExpr(
        "count(*) AS n",
        *[
            f"{a}({number(c)}) AS {a}_{i}"
            for i, c in enumerate(columns)
            for a in ("count", "avg", "min", "max")
        ],
    ).first()
    facts = {
        c: ColumnFacts(
            complete=first[f"count_{i}"] == first["n"],
            constant=first[f"min_{i}"] == first[f"max_{i}"],
            deviation=f"({number(c)} - {sql_double(first[f'avg_{i}'])})",
        )
        for i, c in enumerate(columns)
    }
    if len(pairs) <= PAIRS_PER_SCAN:
        return _pair_sums(df, pairs, facts)
    if not first["n"]:
        return df.sparkSession.createDataFrame(
            [(a, b, 0, None) for a, b in pairs], "col_a string, col_b string, n_complete long, correlation double"
        )
    # A column with an infinity has no deviations: its presence is counted, its range is 0.
    means = [first[f"avg_{i}"] for i in range(len(columns))]
    cells = [
        facts[c].deviation if mean is not None and math.isfinite(mean) else f"IF({quoted(c)} IS NULL, NULL, 0D)"
        for c, mean in zip(columns, means, strict=True)
    ]
    names = f"array({', '.join(map(sql_text, columns))})"
    return pair_sums(df, cells).selectExpr(
        f"{names}[i] AS col_a", f"{names}[j] AS col_b", "n AS n_complete",
        f"IF(varies, {_correlation('n', 'sx', 'sy', 'sxy', 'sxx', 'syy')}, NULL) AS correlation",
    )


@dataclass(frozen=True)
class ColumnFacts:
    """What decides which sums a column needs."""

    complete: bool
    constant: bool
    deviation: str


def _pair_sums(
    df: DataFrame, pairs: list[tuple[str, str]], facts: dict[str, ColumnFacts]
) -> DataFrame:
    measures: dict[str, str] = {}

    def measure(text: str) -> str:
        """The alias of an aggregate, each computed once however many pairs use it."""
        return measures.setdefault(text, f"s{len(measures)}")

    cells = []
    for a, b in pairs:
        x, y = facts[a].deviation, facts[b].deviation
        if facts[a].constant or facts[b].constant:
            n = measure(f"count_if({quoted(a)} IS NOT NULL AND {quoted(b)} IS NOT NULL)")
            corr = "CAST(NULL AS DOUBLE)"
        elif facts[a].complete and facts[b].complete:
            n = measure("count(*)")
            sums = [measure(f"sum({t})") for t in (x, y, f"{x} * {y}", f"{x} * {x}", f"{y} * {y}")]
            corr = _correlation(n, *sums)
        else:
            # A product is NULL when either factor is, so it marks the rows complete in both.
            both = f"{quoted(a)} IS NOT NULL AND {quoted(b)} IS NOT NULL"
            xs, ys = f"IF({both}, {x}, NULL)", f"IF({both}, {y}, NULL)"
            n = measure(f"count({x} * {y})")
            sums = [
                measure(f"sum({t})")
                for t in (xs, ys, f"{x} * {y}", f"{xs} * {xs}", f"{ys} * {ys}")
            ]
            varies = " AND ".join(
                f"{measure(f'min({v})')} < {measure(f'max({v})')}" for v in (xs, ys)
            )
            corr = f"IF({varies}, {_correlation(n, *sums)}, NULL)"
        cells.append(f"{sql_text(a)}, {sql_text(b)}, {n}, {corr}")
    wide = df.selectExpr(*[f"{text} AS {name}" for text, name in measures.items()])
    return wide.selectExpr(
        f"stack({len(cells)}, {', '.join(cells)}) AS (col_a, col_b, n_complete, correlation)"
    )


def _correlation(n: str, sx: str, sy: str, sxy: str, sxx: str, syy: str) -> str:
    spread_x = f"({sxx} - {sx} * {sx} / {n})"
    spread_y = f"({syy} - {sy} * {sy} / {n})"
    quotient = f"try_divide({sxy} - {sx} * {sy} / {n}, sqrt({spread_x}) * sqrt({spread_y}))"
    # NaN, from infinities, counts as missing; Spark takes it for the largest number.
    return f"IF({n} > 1 AND NOT isnan({quotient}), greatest(-1D, least(1D, {quotient})), NULL)"


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``col_a, col_b, correlation`` for all ordered pairs, the diagonal included.

    The diagonal is 1, or NULL for a column that is constant or holds an infinity.
    """
    df = present(df)
    columns = numeric_columns(df, columns)
    pairs = correlation_pairs(df, columns).select("col_a", "col_b", "correlation")
    finite = "max({0}) < double('inf') AND min({0}) > -double('inf')".format
    spreads = [
        f"IF(min({number(c)}) < max({number(c)}) AND {finite(number(c))}, 1D, NULL)" for c in columns
    ]
    diagonal = wide_to_long(df, columns, {"correlation": spreads}).selectExpr(
        "column AS col_a", "column AS col_b", "correlation"
    )
    mirrored = pairs.selectExpr(
        "stack(2, col_a, col_b, correlation, col_b, col_a, correlation)"
        " AS (col_a, col_b, correlation)"
    )
    return mirrored.unionByName(diagonal)
