"""Statistics, p-values and sampling; the SQL integrates densities and sums probabilities."""

from __future__ import annotations

from checks.base import Checks, labelled, normal_p_sql, rounded, student_margin_sql, table
from plumbline.operators import inference

CHECKS = Checks()


@CHECKS.add(
    "one_sample_t_stat",
    """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean,
              round(stddev_samp(l_quantity), 6) AS std,
              round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS standard_error, count(*) - 1 AS df,
              round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS statistic
       FROM lineitem GROUP BY l_returnflag""",
)
def one_sample_t_stat(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(inference.one_sample_moments(lines, "l_quantity", 25.0, ["l_returnflag"]))


# The interval needs the 97.5 % point of the normal distribution, which SQL takes as a number.
ONE_Z = """SELECT 1 AS k, count(value) AS n, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS se,
    (avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))) AS statistic FROM events"""


@CHECKS.add(
    "one_sample_z_stat",
    f"""SELECT n, round(m, 6) AS mean, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value,
               p_value <= 0.05 AS reject_null,
               round(m - 1.959963984540054 * se, 6) AS ci_low, round(m + 1.959963984540054 * se, 6) AS ci_high
        FROM ({ONE_Z}) JOIN ({normal_p_sql(f"SELECT k, statistic FROM ({ONE_Z})", "k")}) USING (k)""",
)
def one_sample_z_stat(spark, sf_dir):
    tested = inference.one_sample_test(table(spark, sf_dir, "events"), "value", "z", mu=50.0)
    return rounded(tested.select("n", "mean", "statistic", "p_value", "reject_null", "ci_low", "ci_high"))


MOMENTS = """SELECT count(*) FILTER (WHERE g = '<a>') AS n_a, count(*) FILTER (WHERE g = '<b>') AS n_b,
    avg(v) FILTER (WHERE g = '<a>') AS mean_a, avg(v) FILTER (WHERE g = '<b>') AS mean_b,
    stddev_samp(v) FILTER (WHERE g = '<a>') AS std_a, stddev_samp(v) FILTER (WHERE g = '<b>') AS std_b
    FROM (SELECT <g> AS g, <v> AS v FROM <t>)"""


def _moments(t: str, v: str, g: str, a: str, b: str) -> str:
    text = MOMENTS
    for key, value in (("<t>", t), ("<v>", v), ("<g>", g), ("<a>", a), ("<b>", b)):
        text = text.replace(key, value)
    return text


PRICES = _moments("lineitem", "l_extendedprice", "l_returnflag", "A", "R")
VALUES = _moments("events", "value", "event_type", "click", "purchase")


@CHECKS.add(
    "two_sample_t_stat",
    f"""WITH v AS (SELECT *, std_a * std_a / n_a AS va, std_b * std_b / n_b AS vb FROM ({PRICES}))
        SELECT n_a, n_b, round(mean_a, 5) AS mean_a, round(mean_b, 5) AS mean_b, round(std_a, 5) AS std_a,
               round(std_b, 5) AS std_b, round(mean_a - mean_b, 5) AS mean_diff,
               round(sqrt(va + vb), 5) AS standard_error,
               round((va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)), 5) AS df,
               round((mean_a - mean_b) / sqrt(va + vb), 5) AS statistic FROM v""",
)
def two_sample_t_stat(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    found = inference.two_sample_moments(lines, "l_extendedprice", "l_returnflag", "A", "R")
    return rounded(found.drop("cohen_d"), 5)


TWO_Z = f"""SELECT 1 AS k, n_a, n_b, mean_a - mean_b AS d, sqrt(std_a * std_a / n_a + std_b * std_b / n_b) AS se,
    (mean_a - mean_b) / sqrt(std_a * std_a / n_a + std_b * std_b / n_b) AS statistic FROM ({VALUES})"""


@CHECKS.add(
    "two_sample_z_stat",
    f"""SELECT n_a, n_b, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, p_value <= 0.05 AS reject_null,
               round(d - 1.959963984540054 * se, 6) AS ci_low, round(d + 1.959963984540054 * se, 6) AS ci_high
        FROM ({TWO_Z}) JOIN ({normal_p_sql(f"SELECT k, statistic FROM ({TWO_Z})", "k")}) USING (k)""",
)
def two_sample_z_stat(spark, sf_dir):
    tested = inference.two_sample_test(
        table(spark, sf_dir, "events"), "value", "event_type", "click", "purchase", "z"
    )
    return rounded(tested.select("n_a", "n_b", "statistic", "p_value", "reject_null", "ci_low", "ci_high"))


BY_TYPE = """SELECT event_type, (avg(value) - 50.3) / (stddev_samp(value) / sqrt(count(value))) AS statistic
    FROM events GROUP BY event_type"""


@CHECKS.add(
    "one_sided_tests",
    " UNION ALL ".join(
        f"""SELECT event_type, '{a}' AS alternative, round(p_value, 6) AS p_value, p_value <= 0.05 AS reject_null
            FROM ({normal_p_sql(BY_TYPE, "event_type", a)})"""
        for a in ("less", "greater")
    ),
)
def one_sided_tests(spark, sf_dir):
    """Both one-sided z tests of every event type."""
    events = table(spark, sf_dir, "events")
    less, greater = (
        inference.one_sample_test(events, "value", "z", 50.3, alternative=a, by=["event_type"])
        for a in ("less", "greater")
    )
    return rounded(less.unionByName(greater).select("event_type", "alternative", "p_value", "reject_null"))


@CHECKS.add(
    "cohens_d",
    f"""SELECT round((mean_a - mean_b)
                     / sqrt(((n_a - 1) * std_a * std_a + (n_b - 1) * std_b * std_b) / (n_a + n_b - 2)), 6)
               AS cohen_d FROM ({VALUES})""",
)
def cohens_d(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = inference.two_sample_moments(events, "value", "event_type", "click", "purchase")
    return rounded(found.select("cohen_d"))


@CHECKS.add(
    "binomial_counts",
    """SELECT lang, k AS successes, n, round(p, 6) AS observed,
              round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6)
                  AS ci_low,
              round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6)
                  AS ci_high
       FROM (SELECT lang, count(*) FILTER (WHERE quality = 1) AS k, count(quality) AS n,
                    count(*) FILTER (WHERE quality = 1) / count(quality) AS p,
                    1.959963984540054::DOUBLE AS z
             FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang)""",
)
def binomial_counts(spark, sf_dir):
    """Unlabelled documents are no trials."""
    return rounded(inference.binomial_counts(labelled(spark, sf_dir), "quality = 1", ["lang"]))


def student_p_sql(tests: str, keys: str) -> str:
    """Two-sided p-values and intervals of ``statistic, df, estimate, se``; the p-values by
    Simpson's rule over the density on [0, |t|]."""
    return f"""
        SELECT {keys}, round(any_value(statistic), 6) AS statistic, round(any_value(df), 6) AS df,
               round(1 - 2 * sum(weight * density), 6) AS p_value,
               1 - 2 * sum(weight * density) <= 0.05 AS reject_null,
               round(any_value(estimate - se * {student_margin_sql("df")}), 6) AS ci_low,
               round(any_value(estimate + se * {student_margin_sql("df")}), 6) AS ci_high
        FROM (SELECT {keys}, statistic, df, estimate, se,
                     abs(statistic) / 3 / 4000 * (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                         AS weight,
                     exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
                         * pow(1 + pow(statistic * i / 4000, 2) / df, -(df + 1) / 2) AS density
              FROM ({tests}), range(4001) r(i))
        GROUP BY {keys}"""


@CHECKS.add(
    "one_sample_t_test",
    student_p_sql(
        """SELECT l_returnflag, (count(*) - 1)::DOUBLE AS df, avg(l_quantity) AS estimate,
                  stddev_samp(l_quantity) / sqrt(count(*)) AS se,
                  (avg(l_quantity) - 25.4) / (stddev_samp(l_quantity) / sqrt(count(*))) AS statistic
           FROM lineitem GROUP BY l_returnflag""",
        "l_returnflag",
    ),
)
def one_sample_t_test(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    found = inference.one_sample_test(lines, "l_quantity", "t", 25.4, by=["l_returnflag"])
    return rounded(
        found.selectExpr(
            "l_returnflag", "statistic", "CAST(df AS DOUBLE) AS df", "p_value", "reject_null", "ci_low", "ci_high"
        )
    )


@CHECKS.add(
    "two_sample_t_test",
    student_p_sql(
        f"""SELECT n_a, (mean_a - mean_b) / sqrt(va + vb) AS statistic, mean_a - mean_b AS estimate, sqrt(va + vb) AS se,
                   (va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)) AS df
            FROM (SELECT *, std_a * std_a / n_a AS va, std_b * std_b / n_b AS vb FROM ({VALUES}))""",
        "n_a",
    ),
)
def two_sample_t_test(spark, sf_dir):
    found = inference.two_sample_test(
        table(spark, sf_dir, "events"), "value", "event_type", "click", "purchase"
    )
    return rounded(found.select("n_a", "statistic", "df", "p_value", "reject_null", "ci_low", "ci_high"))


@CHECKS.add(
    "binomial_test",
    """WITH trials AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS k, count(quality) AS n
                       FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang),
        pmf AS (SELECT lang, k, n, i, exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0)
                                          + i * ln(0.8) + (n - i) * ln(0.2)) AS q
                FROM (SELECT *, unnest(range(n + 1)) AS i FROM trials))
       SELECT a.lang, a.k AS successes, a.n, round(sum(a.q) FILTER (WHERE a.q <= b.q * (1 + 1e-7)), 6) AS p_value,
              sum(a.q) FILTER (WHERE a.q <= b.q * (1 + 1e-7)) <= 0.05 AS reject_null
       FROM pmf a JOIN pmf b ON a.lang = b.lang AND b.i = b.k GROUP BY a.lang, a.k, a.n""",
)
def binomial_test(spark, sf_dir):
    found = inference.binomial_test(labelled(spark, sf_dir), "quality = 1", 0.8, by=["lang"])
    return rounded(found.select("lang", "successes", "n", "p_value", "reject_null"))


SAMPLED = """WITH vals AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r FROM events),
    draws AS (SELECT s.i AS sample,
                     ('0x' || substr(md5('7:' || s.i || ':' || d.i), 1, 15))::BIGINT
                         % (SELECT count(*) FROM vals) AS r
              FROM range(200) s(i), range(30) d(i)),
    means AS (SELECT sample, avg(value) AS m FROM draws JOIN vals USING (r) GROUP BY sample)"""


@CHECKS.add(
    "clt_sampling",
    SAMPLED
    + """ SELECT (SELECT count(*) FROM vals) AS population_n, (SELECT round(avg(value), 6) FROM vals)
             AS population_mean, (SELECT round(stddev_samp(value), 6) FROM vals) AS population_std,
         30::BIGINT AS sample_size, 200::BIGINT AS n_samples, round(avg(m), 6) AS mean_of_means,
         round(stddev_samp(m), 6) AS std_of_means,
         (SELECT round(stddev_samp(value) / sqrt(30), 6) FROM vals) AS theoretical_se,
         round(quantile_cont(m, 0.025), 6) AS p2_5, round(quantile_cont(m, 0.25), 6) AS p25,
         round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.75), 6) AS p75,
         round(quantile_cont(m, 0.975), 6) AS p97_5 FROM means""",
)
def clt_sampling(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rounded(inference.sampling_distribution(events, "value", 30, 200, seed=7))


@CHECKS.add(
    "sample_means_preview",
    SAMPLED + " SELECT sample, round(m, 6) AS sample_mean FROM means ORDER BY sample LIMIT 50",
)
def sample_means_preview(spark, sf_dir):
    means = inference.sample_means(table(spark, sf_dir, "events"), "value", 30, 200, seed=7)
    return rounded(inference.sample_means_preview(means))


METRICS = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "discount": "nullif(l_discount, 0)"}
METRIC_TESTS = " UNION ALL ".join(
    f"""SELECT '{name}' AS metric, l_linestatus, count({text}) FILTER (WHERE l_returnflag = 'A') AS n_a,
               count({text}) FILTER (WHERE l_returnflag = 'R') AS n_b,
               avg({text}) FILTER (WHERE l_returnflag = 'A') - avg({text}) FILTER (WHERE l_returnflag = 'R') AS diff,
               var_samp({text}) FILTER (WHERE l_returnflag = 'A') AS va, var_samp({text}) FILTER (WHERE l_returnflag = 'R') AS vb
        FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_linestatus"""
    for name, text in METRICS.items()
)
METRIC_STATISTICS = f"SELECT *, diff / sqrt(va / n_a + vb / n_b) AS statistic FROM ({METRIC_TESTS})"


@CHECKS.add(
    "two_sample_tests",
    f"""SELECT metric, l_linestatus, n_a, n_b, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value,
               round(least(1, p_value * (SELECT count(*) FROM ({METRIC_STATISTICS}))), 6) AS p_adjusted
        FROM ({METRIC_STATISTICS}) JOIN ({normal_p_sql(METRIC_STATISTICS, "metric, l_linestatus")}) USING (metric, l_linestatus)""",
)
def two_sample_tests(spark, sf_dir):
    """Three metrics in every line status, in one scan."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "nullif(l_discount, 0D) AS discount", "l_returnflag", "l_linestatus"
    )
    found = inference.two_sample_tests(lines, list(METRICS), "l_returnflag", "A", "R", test="z", by=["l_linestatus"])
    return rounded(found.select("metric", "l_linestatus", "n_a", "n_b", "statistic", "p_value", "p_adjusted"))


@CHECKS.add(
    "one_sample_tests",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, l_returnflag, count({c}) AS n, round(avg({c}), 6) AS mean,
                   round((avg({c}) - 25) / (stddev_samp({c}) / sqrt(count({c}))), 6) AS statistic FROM lineitem GROUP BY l_returnflag"""
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def one_sample_tests(spark, sf_dir):
    found = inference.one_sample_tests(
        table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], mu=25.0, by=["l_returnflag"]
    )
    return rounded(found.select("metric", "l_returnflag", "n", "mean", "statistic"))
