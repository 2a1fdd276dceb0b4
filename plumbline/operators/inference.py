"""Hypothesis tests and sampling distributions.

The data is reduced to counts and moments by Spark; p-values are then computed on the
aggregated rows. ``by`` runs a test for every group at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import thresholds as t
from plumbline.columns import col, number, present, quoted, require_numeric, resolve, resolve_all, sql_text
from plumbline.functions.distributions import (
    ALTERNATIVES,
    binomial_p_value,
    normal_p_value,
    normal_quantile,
    student_critical,
    student_p_value,
)
from plumbline.plans.ranks import order_statistics


def _check(test: str, alternative: str, alpha: float) -> tuple[str, str]:
    test, alternative = test.lower(), alternative.lower()
    if test not in ("t", "z"):
        raise ValueError(f"test must be 't' or 'z', not {test!r}")
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}, not {alternative!r}")
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie between 0 and 1")
    return test, alternative


def _decided(df: DataFrame, test: str, alternative: str, alpha: float) -> DataFrame:
    """Add p-value, two-sided interval around ``estimate`` and the decision.

    Needs ``statistic, df, standard_error, estimate``.
    """
    if test == "t":
        p = student_p_value(alternative)(F.col("statistic"), F.col("df"))
        critical = student_critical(alpha)(F.col("df"))
    else:
        p = normal_p_value(alternative)(F.col("statistic"))
        critical = F.lit(normal_quantile(1.0 - alpha / 2.0))
    margin = F.col("critical") * F.col("standard_error")
    return (
        df.withColumns({"p_value": p, "critical": critical})
        .withColumns(
            {
                "alpha": F.lit(alpha),
                "reject_null": F.col("p_value") <= alpha,
                "confidence_level": F.lit(1.0 - alpha),
                "ci_low": F.col("estimate") - margin,
                "ci_high": F.col("estimate") + margin,
                "alternative": F.lit(alternative),
            }
        )
        .drop("critical", "estimate")
    )


def one_sample_moments(
    df: DataFrame, column: str, mu: float = 0.0, by: list[str] | None = None
) -> DataFrame:
    """``by, n, mean, std, standard_error, statistic, df`` of a test of the mean against ``mu``."""
    df = present(df)
    column, by = require_numeric(df, column), resolve_all(df, by or [])
    value = number(column)
    moments = df.groupBy(*[col(c) for c in by]).agg(
        F.expr(f"count({value}) AS n"),
        F.expr(f"avg({value}) AS mean"),
        F.expr(f"stddev_samp({value}) AS std"),
    )
    return moments.selectExpr(
        "*", "std / sqrt(n) AS standard_error", f"n - 1 AS df"
    ).selectExpr("*", f"try_divide(mean - {float(mu)!r}D, standard_error) AS statistic")


def one_sample_test(
    df: DataFrame,
    column: str,
    test: str = "t",
    mu: float = 0.0,
    alternative: str = "two-sided",
    alpha: float = 0.05,
    by: list[str] | None = None,
) -> DataFrame:
    """t or z test of a mean, with the sample deviation as sigma for z."""
    test, alternative = _check(test, alternative, alpha)
    moments = one_sample_moments(df, column, mu, by)
    if test == "z":
        moments = moments.drop("df")
    moments = moments.withColumns(
        {
            "test_type": F.lit(f"one_sample_{test}"),
            "hypothesized_mean": F.lit(float(mu)),
            "estimate": F.col("mean"),
        }
    )
    return _decided(moments, test, alternative, alpha)


def two_sample_moments(
    df: DataFrame,
    column: str,
    group_col: str,
    group_a: object,
    group_b: object,
    by: list[str] | None = None,
) -> DataFrame:
    """Sizes, means, deviations, difference, Welch statistic and df, Cohen's d of two groups.

    Group labels are cast to the type of the group column.
    """
    df = present(df)
    column, group = require_numeric(df, column), resolve(df, group_col)
    by = resolve_all(df, by or [])
    kind = df.schema[group].dataType
    labels = {"a": F.lit(group_a).cast(kind), "b": F.lit(group_b).cast(kind)}
    rows = df.filter(col(group).isin(*labels.values()))
    value = F.expr(number(column))
    measures = []
    for name, label in labels.items():
        mine = F.when(col(group) == label, value)
        measures += [
            F.count(mine).alias(f"n_{name}"),
            F.avg(mine).alias(f"mean_{name}"),
            F.stddev_samp(mine).alias(f"std_{name}"),
        ]
    return (
        rows.groupBy(*[col(c) for c in by])
        .agg(*measures)
        .selectExpr(
            "*",
            "mean_a - mean_b AS mean_diff",
            "std_a * std_a / n_a AS va",
            "std_b * std_b / n_b AS vb",
        )
        .selectExpr(
            "*",
            "sqrt(va + vb) AS standard_error",
            "coalesce(try_divide((va + vb) * (va + vb), va * va / (n_a - 1) + vb * vb / (n_b - 1)),"
            " CAST(n_a + n_b - 2 AS DOUBLE)) AS df",
            "sqrt(((n_a - 1) * std_a * std_a + (n_b - 1) * std_b * std_b) / (n_a + n_b - 2))"
            " AS pooled",
        )
        .selectExpr(
            *[f"{quoted(c)}" for c in by],
            "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b", "mean_diff", "standard_error", "df",
            "try_divide(mean_diff, standard_error) AS statistic",
            "try_divide(mean_diff, pooled) AS cohen_d",
        )
    )


def two_sample_test(
    df: DataFrame,
    column: str,
    group_col: str,
    group_a: object,
    group_b: object,
    test: str = "t",
    alternative: str = "two-sided",
    alpha: float = 0.05,
    by: list[str] | None = None,
) -> DataFrame:
    """Welch t test or z test of the difference of two group means.

    "greater" means that group a has the larger mean. A group without values gives a row
    whose statistic and p-value are NULL.
    """
    test, alternative = _check(test, alternative, alpha)
    moments = two_sample_moments(df, column, group_col, group_a, group_b, by)
    if test == "z":
        moments = moments.drop("df")
    moments = moments.withColumns(
        {"test_type": F.lit(f"two_sample_{test}"), "estimate": F.col("mean_diff")}
    )
    return _decided(moments, test, alternative, alpha)


def _by_metric(df: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    """``metric, value`` of every row and metric, and the columns to keep."""
    metrics = [require_numeric(df, c) for c in dict.fromkeys(metrics)]
    keep = list(dict.fromkeys(keep))
    if not metrics:
        raise ValueError("there is no metric")
    if taken := {"metric", "value"} & {c.lower() for c in keep}:
        raise ValueError(f"rename the columns {sorted(taken)}: the result has columns of that name")
    cells = ", ".join(f"{sql_text(c)}, {number(c)}" for c in metrics)
    return present(df).selectExpr(*map(quoted, keep), f"stack({len(metrics)}, {cells}) AS (metric, value)")


def one_sample_tests(
    df: DataFrame, metrics: list[str], test: str = "t", mu: float = 0.0,
    alternative: str = "two-sided", alpha: float = 0.05, by: list[str] | None = None,
) -> DataFrame:
    """:func:`one_sample_test` of several metrics, and groups, in one scan; ``metric`` tells them apart."""
    by = resolve_all(df, by or [])
    rows = _by_metric(df, [resolve(df, c) for c in metrics], by)
    return one_sample_test(rows, "value", test, mu, alternative, alpha, ["metric", *by])


def two_sample_tests(
    df: DataFrame, metrics: list[str], group_col: str, group_a: object, group_b: object, test: str = "t",
    alternative: str = "two-sided", alpha: float = 0.05, by: list[str] | None = None,
) -> DataFrame:
    """:func:`two_sample_test` of several metrics, and groups, in one scan; ``metric`` tells them apart.

    ``p_adjusted`` is the p-value times the number of tests of the result that have one, 1 at
    most (Bonferroni): rejecting where it is at most alpha keeps the chance of any false
    rejection below alpha, however many metrics and groups are tested.
    """
    by, group = resolve_all(df, by or []), resolve(df, group_col)
    rows = _by_metric(df, [resolve(df, c) for c in metrics], [group, *by])
    tests = two_sample_test(rows, "value", group, group_a, group_b, test, alternative, alpha, ["metric", *by])
    known = tests.agg(F.count("p_value")).scalar()
    return tests.withColumn("p_adjusted", F.when(F.col("p_value").isNotNull(), F.least(F.lit(1.0), F.col("p_value") * known)))


def binomial_counts(
    df: DataFrame, success: str | Column, by: list[str] | None = None, alpha: float = 0.05
) -> DataFrame:
    """``by, successes, n, observed, ci_low, ci_high``: counts and two-sided Wilson interval.

    Rows where the condition is missing are no trials.
    """
    by = resolve_all(df, by or [])
    hit = F.expr(success) if isinstance(success, str) else success
    counted = df.groupBy(*[col(c) for c in by]).agg(
        F.count_if(hit).alias("successes"), F.count(hit).alias("n")
    )
    return wilson_interval(counted, alpha, "two-sided")


def wilson_interval(counted: DataFrame, alpha: float, alternative: str) -> DataFrame:
    """Wilson interval of a share; with a one-sided alternative the other end is open."""
    tail = alpha / 2.0 if alternative == "two-sided" else alpha
    z = f"{normal_quantile(1.0 - tail)!r}D"
    low = "0D" if alternative == "less" else "greatest(0D, (centre - reach) / scale)"
    high = "1D" if alternative == "greater" else "least(1D, (centre + reach) / scale)"
    names = [quoted(c) for c in counted.columns]
    return (
        counted.selectExpr("*", "try_divide(successes, n) AS observed")
        .selectExpr(
            "*",
            f"observed + try_divide({z} * {z}, 2 * n) AS centre",
            f"{z} * sqrt(try_divide(observed * (1 - observed), n)"
            f" + try_divide({z} * {z}, 4D * n * n)) AS reach",
            f"1 + try_divide({z} * {z}, n) AS scale",
        )
        .selectExpr(*names, "observed", f"{low} AS ci_low", f"{high} AS ci_high")
    )


def binomial_from_counts(
    counted: DataFrame, p0: float, alternative: str = "two-sided", alpha: float = 0.05
) -> DataFrame:
    """Exact binomial test of each row's ``successes`` out of ``n`` against ``p0``."""
    _, alternative = _check("t", alternative, alpha)
    if not 0.0 < p0 < 1.0:
        raise ValueError("p0 must lie between 0 and 1")
    return wilson_interval(counted, alpha, alternative).withColumns(
        {"p_value": binomial_p_value(p0, alternative)(F.col("successes"), F.col("n"))}
    ).withColumns(
        {
            "hypothesized": F.lit(float(p0)),
            "alpha": F.lit(alpha),
            "reject_null": F.col("p_value") <= alpha,
            "confidence_level": F.lit(1.0 - alpha),
            "alternative": F.lit(alternative),
        }
    )


def binomial_test(
    df: DataFrame,
    success: str | Column,
    p0: float,
    alternative: str = "two-sided",
    alpha: float = 0.05,
    by: list[str] | None = None,
) -> DataFrame:
    """Exact binomial test of the share of rows that meet a condition."""
    counted = binomial_counts(df, success, by, alpha).drop("observed", "ci_low", "ci_high")
    return binomial_from_counts(counted, p0, alternative, alpha)


def sample_means(
    df: DataFrame, column: str, sample_size: int = 30, n_samples: int = 1000, seed: int = 0
) -> DataFrame:
    """``sample, sample_mean`` of samples drawn with replacement from a column.

    A draw is a rank derived from an MD5 digest of seed, sample and draw, so the same
    seed gives the same samples on any cluster. The ranks are looked up in buckets of
    ordered values; only value frequencies are shuffled.
    """
    df = present(df)
    column = require_numeric(df, column)
    if sample_size <= 0 or n_samples <= 0:
        raise ValueError("a sample needs at least one draw, and there must be at least one sample")
    values = df.selectExpr(f"{number(column)} AS value").filter("value IS NOT NULL")
    size = values.count()
    if not size:
        raise ValueError(f"column {column!r} has no values")
    draws = (
        df.sparkSession.range(n_samples * sample_size)
        .selectExpr(f"id DIV {sample_size} AS sample", f"id % {sample_size} AS draw")
        .selectExpr(
            "sample",
            f"CAST(conv(substr(md5(concat_ws(':', {int(seed)}, sample, draw)), 1, 15), 16, 10)"
            f" AS BIGINT) % {size} AS rank",
        )
    )
    found = order_statistics(values, "value", draws)
    return (
        draws.join(found, "rank")
        .groupBy("sample")
        .agg(F.avg("value").alias("sample_mean"))
    )


PERCENTILES = [0.025, 0.25, 0.5, 0.75, 0.975]


def sampling_distribution(
    df: DataFrame, column: str, sample_size: int = 30, n_samples: int = 1000, seed: int = 0
) -> DataFrame:
    """One row: population estimates, and mean, deviation and percentiles of sample means."""
    means = sample_means(df, column, sample_size, n_samples, seed)
    one = F.lit(0).alias("g")
    population = one_sample_moments(df, column).select(
        one, F.col("n").alias("population_n"), F.col("mean").alias("population_mean"),
        F.col("std").alias("population_std"),
    )
    # There are as many means as the caller asks for, so their percentiles fit one task.
    sampled = means.agg(
        F.avg("sample_mean").alias("mean_of_means"), F.stddev_samp("sample_mean").alias("std_of_means"),
        F.percentile("sample_mean", F.array(*[F.lit(p) for p in PERCENTILES])).alias("q"),
    ).select(one, "*")
    return (
        population.join(F.broadcast(sampled), "g")
        .selectExpr(
            "population_n", "population_mean", "population_std",
            f"CAST({sample_size} AS BIGINT) AS sample_size",
            f"CAST({n_samples} AS BIGINT) AS n_samples",
            "mean_of_means", "std_of_means",
            f"population_std / sqrt({sample_size}) AS theoretical_se",
            "q[0] AS p2_5", "q[1] AS p25", "q[2] AS p50", "q[3] AS p75", "q[4] AS p97_5",
        )
    )


def sample_means_preview(means: DataFrame, n: int = t.PREVIEW_MEANS) -> DataFrame:
    return means.orderBy("sample").limit(n)
