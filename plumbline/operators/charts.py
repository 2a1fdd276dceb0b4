"""The small tables that charts are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import thresholds as t
from plumbline.columns import (
    col,
    drawn,
    families,
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
from plumbline.operators.describe import category_counts, correlation_pairs
from plumbline.operators.outliers import (
    column_limits,
    counts_with_limits,
    limits_from_row,
    outlier_counts,
    summary_from_measures,
)
from plumbline.operators.profile import column_measures, profile_from_measures
from plumbline.plans.draw import exactly
from plumbline.plans.groups import beside
from plumbline.plans.per_column import pin
from plumbline.plans.ranks import column_quantiles, group_quantiles
from plumbline.session import stage

QUARTILES = [0.25, 0.5, 0.75]
STRONG_CORRELATION = 0.3  # fixed value: a second scatter needs more


INFINITY = "double('infinity')"


def _range(value: str) -> list[str]:
    """SQL aggregates ``low, high``: the ends of the finite values."""
    finite = f"FILTER (WHERE abs({value}) < {INFINITY})"
    return [f"min({value}) {finite} AS low", f"max({value}) {finite} AS high"]


def _place(value: str, bins: int, low: float, high: float) -> str:
    """SQL for the bin of a value: 0 up to ``bins`` - 1, -1 and ``bins`` for the infinities."""
    if low == high:
        inner = "0L"
    else:
        width = sql_double((high - low) / bins)
        inner = f"least(CAST(floor(({value} - {sql_double(low)}) / {width}) AS BIGINT), {bins - 1}L)"
    return f"CASE WHEN {value} = -{INFINITY} THEN -1L WHEN {value} = {INFINITY} THEN {bins}L ELSE {inner} END"


def _binned(rows: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """``bin, lower, upper, count`` of equal-width bins, empty ones included, the last closed.

    Infinite values, if any, are counted in bins of their own before and after.
    """
    if low == high:
        bins = 1
    width = (high - low) / bins
    counted = rows.groupBy(F.expr(_place(value, bins, low, high)).alias("bin")).agg(F.count(F.lit(1)).alias("found"))
    # At most two more counted rows than `bins`, as given by the caller.
    return (
        rows.sparkSession.range(-1, bins + 1)
        .withColumnRenamed("id", "bin")
        .join(F.broadcast(counted), "bin", "left")
        .filter(f"bin BETWEEN 0 AND {bins - 1} OR found IS NOT NULL")
        .selectExpr(
            "bin",
            f"CASE bin WHEN -1 THEN -{INFINITY} WHEN {bins} THEN {sql_double(high)}"
            f" ELSE {sql_double(low)} + bin * {sql_double(width)} END AS lower",
            f"CASE bin WHEN -1 THEN {sql_double(low)} WHEN {bins} THEN {INFINITY} WHEN {bins - 1} THEN {sql_double(high)}"
            f" ELSE {sql_double(low)} + (bin + 1) * {sql_double(width)} END AS upper",
            "coalesce(found, 0L) AS count",
        )
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``bin, lower, upper, count`` over the finite range of a numeric column.

    Bin -1 counts values of minus infinity and the bin after the last those of infinity;
    neither is there without such values. A column without finite values is an error.
    """
    if not 1 <= bins <= 100:
        raise ValueError("bins must lie between 1 and 100")
    df = present(df)
    value = number(require_numeric(df, column))
    rows = df.filter(f"{value} IS NOT NULL")
    ends = rows.selectExpr(*_range(value)).first()
    if ends["low"] is None:
        raise ValueError(f"column {column!r} has no values that are finite")
    return _binned(rows, value, bins, ends["low"], ends["high"])


def box_stats(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """``by, n, q1, median, q3, whisker_low, whisker_high, n_fliers`` of a numeric column.

    Whiskers are the furthest values within 1.5 IQR of the box. Rows with a missing group
    key are left out; without any value there is no row. Quartiles come from brackets,
    whiskers and fliers from sums that are combined before the shuffle, so a hot group is
    never gathered. Without ``by`` the fences are constants of the plan.
    """
    df = present(df)
    column, by = require_numeric(df, column), resolve_all(df, by or [])
    keys = [f"k{i}" for i in range(len(by))]
    named = [f"{quoted(c)} AS {k}" for c, k in zip(by, keys, strict=True)]
    rows = df.selectExpr(*named, f"{number(column)} AS value")
    rows = rows.filter(" AND ".join(f"{name} IS NOT NULL" for name in [*keys, "value"]))
    if by:
        quartiles = group_quantiles(rows, keys, "value", QUARTILES)
        counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        boxes = stage(quartiles.join(counted, keys).selectExpr(*keys, "n", "q[0] AS q1", "q[1] AS median", "q[2] AS q3"))
        rows = beside(rows, keys, boxes.drop("median")).drop("n")
        q1, q3 = "q1", "q3"
    else:
        found = column_quantiles(rows, ["value"], QUARTILES).first()
        q1, median, q3 = map(sql_double, found["q"] if found else [None] * 3)
    fence = f"{t.IQR_FENCE}D * ({q3} - {q1})"
    inside = f"value >= {q1} - {fence} AND value <= {q3} + {fence}"
    measures = [
        F.expr(f"min(value) FILTER (WHERE {inside}) AS whisker_low"),
        F.expr(f"max(value) FILTER (WHERE {inside}) AS whisker_high"),
        F.expr(f"count_if(NOT ({inside})) AS n_fliers"),
    ]
    if by:
        out = boxes.join(rows.groupBy(*keys).agg(*measures), keys)
    else:
        out = rows.agg(F.expr("count(*) AS n"), *measures).filter("n > 0")
        out = out.selectExpr("*", f"{q1} AS q1", f"{median} AS median", f"{q3} AS q3")
    return out.selectExpr(
        *[f"{k} AS {quoted(c)}" for c, k in zip(by, keys, strict=True)],
        "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_fliers",
    )


def scatter_points(
    df: DataFrame, x: str, y: str, hue: str | None = None,
    fraction: float | None = None, seed: int = 0, rows: int | None = None,
) -> DataFrame:
    """``x, y`` (and ``hue``) of the rows that have both.

    ``fraction`` draws by a digest of seed and point, so every cluster draws the same;
    equal points are drawn together. ``rows`` draws exactly so many points, or all if there
    are fewer, by the same digest.
    """
    if fraction is not None and rows is not None:
        raise ValueError("give a fraction or a number of rows, not both")
    df = present(df)
    names = {"x": resolve(df, x), "y": resolve(df, y)}
    if hue is not None:
        names["hue"] = resolve(df, hue)
    points = df.select(*[col(c).alias(k) for k, c in names.items()])
    points = points.filter("x IS NOT NULL AND y IS NOT NULL")
    if rows is not None:
        if rows < 0:
            raise ValueError("rows must be 0 or more")
        return exactly(points, F.lit(""), F.lit(rows), drawn(list(names), seed), F.lit(0))
    if fraction is None:
        return points
    return points.filter(drawn(list(names), seed) < fraction)


def scatter_grid(df: DataFrame, x: str, y: str, cells: int = 20) -> DataFrame:
    """``x_bin, y_bin, count``: all points of a scatter chart, counted on a grid of the finite range.

    Infinite coordinates lie in bin -1 or in the one after the last.
    """
    df = present(df)
    vx, vy = number(require_numeric(df, x)), number(require_numeric(df, y))
    rows = df.filter(f"{vx} IS NOT NULL AND {vy} IS NOT NULL").selectExpr(f"{vx} AS vx", f"{vy} AS vy")
    (x0, x1), (y0, y1) = (
        rows.selectExpr(*_range("vx"), *[text.replace(" AS ", " AS y_") for text in _range("vy")])
        .selectExpr("array(low, high) AS x", "array(y_low, y_high) AS y")
        .first()
    )
    places = [_place(v, cells, *(ends if ends[0] is not None else (0.0, 0.0))) for v, ends in (("vx", (x0, x1)), ("vy", (y0, y1)))]
    return rows.groupBy(F.expr(places[0]).alias("x_bin"), F.expr(places[1]).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("count")
    )


def _keys(df: DataFrame, x: str, hue: str | None) -> list[str]:
    return [resolve(df, c) for c in ([x] if hue is None else [x, hue])]


def _all_present(keys: list[str]) -> str:
    return " AND ".join(f"{quoted(k)} IS NOT NULL" for k in keys)


def bar_counts(df: DataFrame, x: str, hue: str | None = None) -> DataFrame:
    """Rows per category (and hue); rows without a category are left out."""
    df = present(df)
    keys = _keys(df, x, hue)
    return (
        df.filter(_all_present(keys))
        .groupBy(*[col(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("count"))
    )


def bar_means(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Mean of ``y`` per category with a 95 % interval.

    The interval is the normal approximation; :func:`bootstrap_means` has one from replicates.
    """
    df = present(df)
    value, keys = number(require_numeric(df, y)), _keys(df, x, hue)
    grouped = (
        df.filter(_all_present(keys))
        .groupBy(*[col(k) for k in keys])
        .agg(
            F.expr(f"count({value}) AS n"),
            F.expr(f"avg({value}) AS mean"),
            F.expr(f"stddev_samp({value}) AS std"),
        )
    )
    reach = "1.959963984540054D * std / sqrt(n)"  # fixed value: 97.5 % point of the normal
    return grouped.selectExpr("*", f"mean - {reach} AS ci_low", f"mean + {reach} AS ci_high")


# The Poisson distribution with mean 1, times 65536, from 0 events up.
POISSON = [24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535]
DRAWS_PER_DIGEST = 8  # an MD5 digest has eight numbers of 16 bits


def bootstrap_means(
    df: DataFrame, x: str, y: str, hue: str | None = None,
    replicates: int = 200, seed: int = 0, key: list[str] | None = None,
) -> DataFrame:
    """Mean of ``y`` per category with a 95 % bootstrap interval: ``n, mean, std, ci_low, ci_high``.

    A Poisson bootstrap in one pass: in each replicate a row counts 0, 1, 2 ... times, by a
    digest of seed and ``key``, and the interval holds the middle 95 % of the replicates' means. ``key``
    should tell rows apart (all columns if none is given): rows that are equal in it are
    drawn together. Sums of the replicates are combined in the tasks, so what moves is a
    row per category and eight replicates, whatever the size of a category. ``replicates`` is
    rounded up to a multiple of eight. Rows without a category or value are left out; a
    replicate that drew no row of a category is left out of its interval.
    """
    if not 8 <= replicates <= 10_000:
        raise ValueError("replicates must lie between 8 and 10000")
    df = present(df)
    value, keys = number(require_numeric(df, y)), _keys(df, x, hue)
    kinds = families(df)
    told = [c for c in resolve_all(df, key) if kinds[c] != "other"]
    text = ", ".join([sql_text(str(int(seed))), *[f"coalesce(CAST({quoted(c)} AS STRING), '-')" for c in told]])
    named = [f"{quoted(k)} AS g{i}" for i, k in enumerate(keys)]
    by = [f"g{i}" for i in range(len(keys))]
    rows = df.filter(f"{_all_present(keys)} AND {value} IS NOT NULL").selectExpr(
        *named, f"{value} AS v", f"concat_ws(':', {text}) AS told"
    )
    blocks = -(-replicates // DRAWS_PER_DIGEST)
    drawn_rows = rows.selectExpr("*", f"explode(sequence(0, {blocks - 1})) AS block").selectExpr(
        *by, "v", "block", "md5(concat(told, '/', block)) AS d"
    )
    number_at = "CAST(conv(substring(d, {}, 4), 16, 10) AS INT)".format
    times = [
        " + ".join(f"CAST({number_at(4 * i + 1)} >= {c} AS INT)" for c in POISSON) + f" AS w{i}"
        for i in range(DRAWS_PER_DIGEST)
    ]
    sums = [f"sum({part}) AS {name}{i}" for i in range(DRAWS_PER_DIGEST) for name, part in (("s", f"w{i}"), ("t", f"w{i} * v"))]
    drawn_sums = drawn_rows.selectExpr(*by, "v", "block", *times).groupBy(*by, "block").agg(*map(F.expr, sums))
    means = ", ".join(f"try_divide(t{i}, s{i})" for i in range(DRAWS_PER_DIGEST))
    ends = (
        drawn_sums.selectExpr(*by, f"explode(array({means})) AS m")
        .groupBy(*by).agg(F.expr("percentile(m, array(0.025, 0.975)) AS q"))
    )
    plain = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )
    back = [f"{g} AS {quoted(k)}" for g, k in zip(by, keys, strict=True)]
    return plain.join(ends, by).selectExpr(*back, "n", "mean", "std", "q[0] AS ci_low", "q[1] AS ci_high")


def line_means(
    df: DataFrame, x: str, y: str, hue: str | None = None, every: str | None = None
) -> DataFrame:
    """``x, (hue,) n, mean`` of ``y`` in order of ``x``; ``every`` truncates times, as "day"."""
    df = present(df)
    value, keys = number(require_numeric(df, y)), _keys(df, x, hue)
    place = col(keys[0]) if every is None else F.date_trunc(every, col(keys[0]))
    grouping = [place.alias("x"), *[col(k).alias("hue") for k in keys[1:]]]
    return (
        df.filter(_all_present(keys))
        .filter(f"{value} IS NOT NULL")
        .groupBy(*grouping)
        .agg(F.count(F.lit(1)).alias("n"), F.expr(f"avg({value}) AS mean"))
        .orderBy("x")
    )


def composition(df: DataFrame, column: str) -> DataFrame:
    """``value, is_missing, count, share``: the slices of a pie, missing values included."""
    return category_counts(df, [column]).drop("column")


CHARTS = ("bar", "box", "histogram", "line", "pie", "scatter")


def chart_kind(name: str) -> str:
    """The plain name of a chart: "Box_plot" is a box, "bar-chart" a bar, "hist" a histogram."""
    plain = name.lower().replace("_", "").replace("-", "").replace(" ", "")
    kind = plain.removesuffix("chart").removesuffix("plot")
    kind = "histogram" if kind == "hist" else kind
    if kind not in CHARTS:
        raise ValueError(f"chart must be one of {CHARTS}, not {name!r}")
    return kind


def chart_table(
    df: DataFrame, chart: str, x: str, y: str | None = None, hue: str | None = None, bins: int = 10
) -> DataFrame:
    """The table behind a chart given by its kind and columns."""
    kind = chart_kind(chart)
    if y is None and kind in ("scatter", "line"):
        raise ValueError(f"a {kind} chart needs both x and y")
    if kind == "histogram":
        return histogram(df, x, bins)
    if kind == "box":
        return box_stats(df, x) if y is None else box_stats(df, y, [x] if hue is None else [x, hue])
    if kind == "scatter":
        return scatter_points(df, x, y, hue)
    if kind == "line":
        return line_means(df, x, y, hue)
    if kind == "pie":
        return composition(df, x)
    return bar_counts(df, x, hue) if y is None else bar_means(df, x, y, hue)


# ---- with and without outliers ----------------------------------------------


def outlier_comparison(df: DataFrame, column: str) -> DataFrame:
    """One row: values, outliers by the fences, values left, share and fences."""
    counts = outlier_counts(df, [require_numeric(df, column)], "iqr")
    return counts.selectExpr(
        "column", "n AS total_values", "outlier_count AS outliers_removed",
        "n - outlier_count AS clean_values", "outlier_pct", "lower_bound", "upper_bound",
    )


def comparison_chart(df: DataFrame, column: str, chart: str = "box") -> DataFrame:
    """The box or the histogram of a column with and without outliers, told apart by ``side``.

    Both histograms use the same number of bins, each over its own range.
    """
    df = present(df)
    column = require_numeric(df, column)
    value = number(column)
    every = df.filter(f"{value} IS NOT NULL").selectExpr(f"{value} AS value")
    outlier = column_limits(df, [column], "iqr")[column].flag("value")
    sides = {"with_outliers": every, "without_outliers": every.filter(f"NOT ({outlier})")}
    if chart == "histogram":
        ends = {
            name: side.selectExpr("count(*) AS n", *_range("value")).first()
            for name, side in sides.items()
        }
        if any(end["low"] is None for end in ends.values()):
            raise ValueError(f"column {column!r} has no values that are finite")
        bins = max(1, min(30, int(ends["with_outliers"]["n"] ** 0.5)))
        parts = {
            name: _binned(side, "value", bins, ends[name]["low"], ends[name]["high"])
            for name, side in sides.items()
        }
    elif chart == "box":
        parts = {name: box_stats(side, "value") for name, side in sides.items()}
    else:
        raise ValueError(f"chart must be 'box' or 'histogram', not {chart!r}")
    tagged = [part.select(F.lit(name).alias("side"), "*") for name, part in parts.items()]
    return tagged[0].unionByName(tagged[1])


# ---- which charts to draw ---------------------------------------------------


def chart_recommendations(df: DataFrame, most: int = 7) -> DataFrame:
    """``role, place, chart, x, y, score``: up to ``most`` charts that show the most.

    Two histograms by outliers, two boxes by IQR relative to the range, two bars for
    categories of 3 to 10 values, a scatter for the strongest correlation and one for the next
    if it is above 0.3, one line over a time column, one pie for a category of at most 6
    values. Ranks run over tables with one row per column or pair of columns.
    """
    df = present(df)
    measures = column_measures(df, df.columns)
    profile, summary = profile_from_measures(measures), summary_from_measures(measures)
    limits = {row["column"]: limits_from_row(row, "both") for row in summary.collect()}
    counts = pin(counts_with_limits(df, limits, "both"))
    empty = "CAST(NULL AS STRING) AS y"
    numeric = summary.join(F.broadcast(counts.select("column", "outlier_count")), "column")
    parts = [
        numeric.selectExpr(
            "1 AS role", "2 AS keep", "'histogram' AS chart", "column AS x", empty,
            "CAST(outlier_count AS DOUBLE) AS score",
        ),
        numeric.selectExpr(
            "2 AS role", "2 AS keep", "'box' AS chart", "column AS x", empty,
            "coalesce(try_divide(max - min, iqr), 0D) AS score",
        ),
        profile.filter("family IN ('text', 'boolean') AND n_unique BETWEEN 3 AND 10").selectExpr(
            "3 AS role", "2 AS keep", "'bar' AS chart", "column AS x", empty,
            "CAST(n_unique AS DOUBLE) AS score",
        ),
        profile.filter("family IN ('text', 'boolean') AND n_unique BETWEEN 2 AND 6").selectExpr(
            "6 AS role", "1 AS keep", "'pie' AS chart", "column AS x", empty,
            "-CAST(n_unique AS DOUBLE) AS score",
        ),
    ]
    names = numeric_columns(df)
    if len(names) > 1:
        pairs = correlation_pairs(df, names).filter("correlation IS NOT NULL")
        parts.append(
            pairs.selectExpr(
                "4 AS role", "2 AS keep", "'scatter' AS chart", "col_a AS x", "col_b AS y",
                "abs(correlation) AS score",
            )
        )
    if names:
        parts.append(
            profile.filter("family = 'datetime'").selectExpr(
                "5 AS role", "1 AS keep", "'line' AS chart", "column AS x",
                f"{sql_text(names[-1])} AS y", "CAST(n_unique AS DOUBLE) AS score",
            )
        )
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    best = Window.partitionBy("role").orderBy(F.col("score").desc(), "x", "y")
    return (
        candidates.withColumn("place", F.row_number().over(best))
        .filter(f"place <= keep AND (role <> 4 OR place = 1 OR score > {STRONG_CORRELATION}D)")
        .orderBy("place", "role")
        .limit(most)
        .selectExpr("role", "place", "chart", "x", "y", "score")
    )
