"""Chart tables."""

from __future__ import annotations

from checks.base import LABELLED, Checks, labelled, outlier_sql, rounded, table
from plumbline.operators import charts, outliers

CHECKS = Checks()


def histogram_sql(source: str, column: str, bins: str) -> str:
    """Bins of equal width over the range; ``bins`` may be SQL."""
    return f"""
        SELECT b.bin, round(lo + b.bin * w, 6) AS lower,
               round(CASE WHEN b.bin = k - 1 THEN hi ELSE lo + (b.bin + 1) * w END, 6) AS upper,
               coalesce(found, 0) AS count
        FROM (SELECT min("{column}")::DOUBLE AS lo, max("{column}")::DOUBLE AS hi, ({bins})::BIGINT AS k,
                     (max("{column}")::DOUBLE - min("{column}")::DOUBLE) / ({bins}) AS w FROM {source}) e,
             LATERAL (SELECT unnest(range(e.k)) AS bin) b
        LEFT JOIN (SELECT least(floor(("{column}" - lo) / ((hi - lo) / k))::BIGINT, k - 1) AS bin,
                          count(*) AS found
                   FROM {source}, (SELECT min("{column}")::DOUBLE AS lo, max("{column}")::DOUBLE AS hi,
                                          ({bins})::BIGINT AS k FROM {source})
                   WHERE "{column}" IS NOT NULL GROUP BY 1) c ON c.bin = b.bin"""


@CHECKS.add("histogram_bins", histogram_sql("events", "value", "10"))
def histogram_bins(spark, sf_dir):
    return rounded(charts.histogram(table(spark, sf_dir, "events"), "value"))


# Events whose value is infinite every now and then.
UNBOUNDED = """(SELECT CASE user_id % 97 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE ELSE value END AS value,
                       user_id FROM events)"""


def unbounded(spark, sf_dir):
    infinite = "CASE user_id % 97 WHEN 0 THEN double('inf') WHEN 1 THEN -double('inf') ELSE value END AS value"
    return table(spark, sf_dir, "events").selectExpr(infinite, "user_id")


@CHECKS.add(
    "histogram_with_infinities",
    "SELECT * FROM ("
    + histogram_sql(f"(SELECT value FROM {UNBOUNDED} WHERE isfinite(value))", "value", "10")
    + f""") UNION ALL
        SELECT CASE WHEN value > 0 THEN 10 ELSE -1 END, CASE WHEN value > 0 THEN round(hi, 6) ELSE value END,
               CASE WHEN value > 0 THEN value ELSE round(lo, 6) END, count(*)
        FROM {UNBOUNDED}, (SELECT min(value) AS lo, max(value) AS hi FROM {UNBOUNDED} WHERE isfinite(value))
        WHERE isinf(value) GROUP BY 1, 2, 3""",
)
def histogram_with_infinities(spark, sf_dir):
    return rounded(charts.histogram(unbounded(spark, sf_dir), "value"))


@CHECKS.add(
    "scatter_grid_with_infinities",
    f"""SELECT CASE WHEN isinf(value) THEN if(value > 0, 20, -1)
                    ELSE least(floor((value - x0) / ((x1 - x0) / 20))::BIGINT, 19) END AS x_bin,
               least(floor((user_id - y0) / ((y1 - y0) / 20))::BIGINT, 19) AS y_bin, count(*) AS count
        FROM {UNBOUNDED}, (SELECT min(value) FILTER (WHERE isfinite(value)) AS x0, max(value) FILTER (WHERE isfinite(value)) AS x1,
                                  min(user_id)::DOUBLE AS y0, max(user_id)::DOUBLE AS y1 FROM {UNBOUNDED}) GROUP BY 1, 2""",
)
def scatter_grid_with_infinities(spark, sf_dir):
    return charts.scatter_grid(unbounded(spark, sf_dir), "value", "user_id")


def box_sql(source: str, column: str, keys: list[str]) -> str:
    names = ", ".join(keys)
    lead = f"{names}, " if keys else ""
    group = f"GROUP BY {names}" if keys else ""
    join = " AND ".join(f"v.{k} = q.{k}" for k in keys) or "true"
    lead_v = "".join(f"v.{k}, " for k in keys)
    group_v = "GROUP BY " + ", ".join(f"v.{k}" for k in keys) if keys else ""
    present = "".join(f" AND {k} IS NOT NULL" for k in keys)
    inside = "x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    rows = f"(SELECT {lead}{column}::DOUBLE AS x FROM {source} WHERE {column} IS NOT NULL{present})"
    return f"""
        SELECT {lead_v}count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(md), 6) AS median,
               round(any_value(q3), 6) AS q3, min(x) FILTER (WHERE {inside}) AS whisker_low,
               max(x) FILTER (WHERE {inside}) AS whisker_high,
               count(*) FILTER (WHERE NOT ({inside})) AS n_fliers
        FROM {rows} v JOIN (SELECT {lead}quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS md,
                                   quantile_cont(x, 0.75) AS q3 FROM {rows} {group}) q ON {join} {group_v}"""


@CHECKS.add("box_stats", box_sql("documents", "n_chars", []))
def box_stats(spark, sf_dir):
    return rounded(charts.box_stats(table(spark, sf_dir, "documents"), "n_chars"))


@CHECKS.add("box_stats_by_group", box_sql(LABELLED, "n_chars", ["lang", "quality"]))
def box_stats_by_group(spark, sf_dir):
    return rounded(charts.box_stats(labelled(spark, sf_dir), "n_chars", ["lang", "quality"]))


@CHECKS.add(
    "scatter_points",
    f"SELECT n_chars AS x, quality AS y, lang AS hue FROM {LABELLED} WHERE quality IS NOT NULL",
)
def scatter_points(spark, sf_dir):
    return charts.scatter_points(labelled(spark, sf_dir), "n_chars", "quality", "lang")


@CHECKS.add(
    "scatter_grid",
    """SELECT least(floor((l_extendedprice - x0) / ((x1 - x0) / 20))::BIGINT, 19) AS x_bin,
              least(floor((l_quantity - y0) / ((y1 - y0) / 20))::BIGINT, 19) AS y_bin, count(*) AS count
       FROM lineitem, (SELECT min(l_extendedprice) AS x0, max(l_extendedprice) AS x1,
                              min(l_quantity) AS y0, max(l_quantity) AS y1 FROM lineitem) GROUP BY 1, 2""",
)
def scatter_grid(spark, sf_dir):
    return charts.scatter_grid(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")


@CHECKS.add(
    "bar_counts",
    f"""SELECT lang, quality, count(*) AS count FROM {LABELLED}
        WHERE lang IS NOT NULL AND quality IS NOT NULL GROUP BY 1, 2""",
)
def bar_counts(spark, sf_dir):
    return charts.bar_counts(labelled(spark, sf_dir), "lang", "quality")


@CHECKS.add(
    "bar_means",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(m, 4) AS mean, round(s, 4) AS std,
              round(m - 1.959963984540054 * s / sqrt(n), 4) AS ci_low,
              round(m + 1.959963984540054 * s / sqrt(n), 4) AS ci_high
       FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n, avg(o_totalprice) AS m,
                    stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1, 2)""".replace(
        "count(*) AS n, round", "n, round"
    ),
)
def bar_means(spark, sf_dir):
    found = charts.bar_means(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus"
    )
    return rounded(found, 4)


POISSON_SQL = " + ".join(f"(u >= {c})::INT" for c in charts.POISSON)


@CHECKS.add(
    "bootstrap_means",
    f"""WITH d AS (SELECT o_orderpriority, o_orderstatus, o_totalprice AS v, b * 8 + i AS r,
                          ('0x' || substr(md5('7:' || o_orderkey || '/' || b), 4 * i + 1, 4))::INT AS u
                   FROM orders, range(5) blocks(b), range(8) draws(i)),
        m AS (SELECT o_orderpriority, o_orderstatus, r, sum(({POISSON_SQL}) * v) / nullif(sum({POISSON_SQL}), 0) AS m
              FROM d GROUP BY ALL),
        q AS (SELECT o_orderpriority, o_orderstatus, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi
              FROM m GROUP BY ALL)
        SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean,
               round(stddev_samp(o_totalprice), 4) AS std, round(any_value(lo), 4) AS ci_low, round(any_value(hi), 4) AS ci_high
        FROM orders JOIN q USING (o_orderpriority, o_orderstatus) GROUP BY ALL""",
)
def bootstrap_means(spark, sf_dir):
    found = charts.bootstrap_means(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus", replicates=40, seed=7, key=["o_orderkey"]
    )
    return rounded(found, 4)


@CHECKS.add(
    "scatter_sample",
    """SELECT l_quantity AS x, l_extendedprice AS y FROM
           (SELECT l_quantity, l_extendedprice, row_number() OVER
                (ORDER BY md5('2:' || l_quantity || ':' || l_extendedprice)[:12]) AS place FROM
            (SELECT DISTINCT l_quantity, l_extendedprice FROM lineitem WHERE l_quantity = 7.0))
       WHERE place <= 100""",
)
def scatter_sample(spark, sf_dir):
    """A hundred different points of one quantity."""
    points = table(spark, sf_dir, "lineitem").filter("l_quantity = 7").select("l_quantity", "l_extendedprice").distinct()
    return charts.scatter_points(points, "l_quantity", "l_extendedprice", seed=2, rows=100)


@CHECKS.add(
    "line_means",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS x, event_type AS hue, count(*) AS n,
              round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""",
)
def line_means(spark, sf_dir):
    found = charts.line_means(table(spark, sf_dir, "events"), "ts", "value", "event_type", every="day")
    return rounded(found.selectExpr("date_format(x, 'yyyy-MM-dd') AS x", "hue", "n", "mean"))


@CHECKS.add(
    "composition_shares",
    f"""SELECT toxic::VARCHAR AS value, toxic IS NULL AS is_missing, count(*) AS count,
               round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {LABELLED} GROUP BY toxic""",
)
def composition_shares(spark, sf_dir):
    return rounded(charts.composition(labelled(spark, sf_dir), "toxic"))


@CHECKS.add(
    "outlier_comparison",
    f"""SELECT "column", n AS total_values, outlier_count AS outliers_removed, n - outlier_count AS clean_values,
               round(outlier_pct, 6) AS outlier_pct, round(lower_bound, 6) AS lower_bound,
               round(upper_bound, 6) AS upper_bound FROM ({outlier_sql("events", ["value"], "iqr")})""",
)
def outlier_comparison(spark, sf_dir):
    return rounded(charts.outlier_comparison(table(spark, sf_dir, "events"), "value"))


CLEAN = f"""(SELECT value FROM events,
    (SELECT lower_bound AS lb, upper_bound AS ub FROM ({outlier_sql("events", ["value"], "iqr")}))
    WHERE value BETWEEN lb AND ub)"""
BINS = "(SELECT least(30, floor(sqrt(count(value)))) FROM events)"


@CHECKS.add(
    "comparison_box",
    f"SELECT 'with_outliers' AS side, * FROM ({box_sql('events', 'value', [])}) UNION ALL "
    f"SELECT 'without_outliers', * FROM ({box_sql(CLEAN, 'value', [])})",
)
def comparison_box(spark, sf_dir):
    return rounded(charts.comparison_chart(table(spark, sf_dir, "events"), "value"))


@CHECKS.add(
    "comparison_histogram",
    f"""WITH clean AS {CLEAN}, bins AS (SELECT {BINS}::BIGINT AS k),
        sides AS (SELECT 'with_outliers' AS side, value AS x FROM events
                  UNION ALL SELECT 'without_outliers', value FROM clean),
        ends AS (SELECT side, min(x) AS lo, max(x) AS hi FROM sides GROUP BY side),
        found AS (SELECT s.side, least(floor((x - lo) / ((hi - lo) / k))::BIGINT, k - 1) AS bin, count(*) AS c
                  FROM sides s JOIN ends e ON s.side = e.side, bins GROUP BY 1, 2),
        grid AS (SELECT side, lo, hi, k, unnest(range(k)) AS bin FROM ends, bins)
        SELECT g.side, g.bin, round(lo + g.bin * ((hi - lo) / k), 6) AS lower,
               round(CASE WHEN g.bin = k - 1 THEN hi ELSE lo + (g.bin + 1) * ((hi - lo) / k) END, 6) AS upper,
               coalesce(c, 0) AS count
        FROM grid g LEFT JOIN found f ON f.side = g.side AND f.bin = g.bin""",
)
def comparison_histogram(spark, sf_dir):
    return rounded(charts.comparison_chart(table(spark, sf_dir, "events"), "value", "histogram"))


@CHECKS.add(
    "comparison_candidates",
    f"""SELECT "column", outlier_count, round(outlier_pct, 6) AS outlier_pct
        FROM ({outlier_sql(LABELLED, ["doc_id", "n_chars", "quality", "toxic"], "iqr")})
        WHERE outlier_pct > 0.10""",
)
def comparison_candidates(spark, sf_dir):
    counts = outliers.outlier_counts(labelled(spark, sf_dir), None, "iqr")
    return rounded(outliers.comparison_candidates(counts))


NUMBERS = ["event_id", "user_id", "value"]
ROLE_NUMBERS = " UNION ALL ".join(
    f"""SELECT '{c}' AS c, max("{c}")::DOUBLE - min("{c}")::DOUBLE AS rng,
               quantile_cont("{c}"::DOUBLE, 0.75) - quantile_cont("{c}"::DOUBLE, 0.25) AS iqr FROM events"""
    for c in NUMBERS
)


@CHECKS.add(
    "chart_recommendations",
    f"""WITH outl AS ({outlier_sql("events", NUMBERS, "both")}), spans AS ({ROLE_NUMBERS}),
        cand AS (
            SELECT 1 AS role, 2 AS keep, 'histogram' AS chart, "column" AS x, NULL AS y,
                   outlier_count::DOUBLE AS score FROM outl
            UNION ALL SELECT 2, 2, 'box', c, NULL, rng / iqr FROM spans
            UNION ALL SELECT 3, 2, 'bar', 'event_type', NULL, count(DISTINCT event_type)::DOUBLE
                      FROM events HAVING count(DISTINCT event_type) BETWEEN 3 AND 10
            UNION ALL SELECT 3, 2, 'bar', 'props', NULL, count(DISTINCT props)::DOUBLE
                      FROM events HAVING count(DISTINCT props) BETWEEN 3 AND 10
            UNION ALL SELECT 6, 1, 'pie', 'event_type', NULL, -count(DISTINCT event_type)::DOUBLE
                      FROM events HAVING count(DISTINCT event_type) BETWEEN 2 AND 6
            UNION ALL SELECT 6, 1, 'pie', 'props', NULL, -count(DISTINCT props)::DOUBLE
                      FROM events HAVING count(DISTINCT props) BETWEEN 2 AND 6
            UNION ALL SELECT 4, 2, 'scatter', 'event_id', 'user_id', abs(corr(event_id, user_id)) FROM events
            UNION ALL SELECT 4, 2, 'scatter', 'event_id', 'value', abs(corr(event_id, value)) FROM events
            UNION ALL SELECT 4, 2, 'scatter', 'user_id', 'value', abs(corr(user_id, value)) FROM events
            UNION ALL SELECT 5, 1, 'line', 'ts', 'value', count(DISTINCT ts)::DOUBLE FROM events),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, x, y) AS place FROM cand)
        SELECT role, place::INT AS place, chart, x, y, round(score, 6) AS score FROM ranked
        WHERE place <= keep AND (role <> 4 OR place = 1 OR score > 0.3) ORDER BY ranked.place, role LIMIT 7""",
)
def chart_recommendations(spark, sf_dir):
    return rounded(charts.chart_recommendations(table(spark, sf_dir, "events")))


SHIPPED = """(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_returnflag, l_linestatus || l_linenumber % 4 AS line
    FROM lineitem)"""
SHIPPED_NUMBERS = ["l_quantity", "l_extendedprice", "net"]


@CHECKS.add(
    "chart_recommendations_wide",
    f"""WITH outl AS ({outlier_sql(SHIPPED, SHIPPED_NUMBERS, "both")}),
        spans AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS c, max({c}) - min({c}) AS rng, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {SHIPPED}"
        for c in SHIPPED_NUMBERS
    )
    + "), cand AS (SELECT 1 AS role, 2 AS keep, 'histogram' AS chart, \"column\" AS x, NULL AS y, outlier_count::DOUBLE AS score FROM outl"
    + " UNION ALL SELECT 2, 2, 'box', c, NULL, rng / iqr FROM spans"
    + "".join(
        f""" UNION ALL SELECT 3, 2, 'bar', '{c}', NULL, count(DISTINCT {c})::DOUBLE FROM {SHIPPED} HAVING count(DISTINCT {c}) BETWEEN 3 AND 10
             UNION ALL SELECT 6, 1, 'pie', '{c}', NULL, -count(DISTINCT {c})::DOUBLE FROM {SHIPPED} HAVING count(DISTINCT {c}) BETWEEN 2 AND 6"""
        for c in ("l_returnflag", "line")
    )
    + "".join(
        f" UNION ALL SELECT 4, 2, 'scatter', '{a}', '{b}', abs(corr({a}, {b})) FROM {SHIPPED}"
        for i, a in enumerate(SHIPPED_NUMBERS) for b in SHIPPED_NUMBERS[i + 1 :]
    )
    + """), ranked AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, x, y) AS place FROM cand)
        SELECT role, place::INT AS place, chart, x, y, round(score, 6) AS score FROM ranked
        WHERE place <= keep AND (role <> 4 OR place = 1 OR score > 0.3) ORDER BY ranked.place, role LIMIT 9""",
)
def chart_recommendations_wide(spark, sf_dir):
    """Two scatters and two bars: several strong pairs and two categories."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net", "l_returnflag",
        "concat(l_linestatus, l_linenumber % 4) AS line",
    )
    return rounded(charts.chart_recommendations(lines, most=9))
