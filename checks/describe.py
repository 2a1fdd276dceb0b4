"""Univariate, bivariate, contingency and correlation summaries."""

from __future__ import annotations

from itertools import product

from checks.base import (
    LABELLED,
    PRICED,
    Checks,
    labelled,
    outlier_sql,
    priced,
    rounded,
    table,
    union,
)
from plumbline.operators import describe

CHECKS = Checks()

MODES = """SELECT '<c>' AS "column", "<c>"::DOUBLE AS value, count(*) AS cnt FROM <source>
    WHERE "<c>" IS NOT NULL GROUP BY "<c>"
    QUALIFY count(*) = max(count(*)) OVER ()"""
DOC_NUMBERS = ["doc_id", "n_chars", "quality", "toxic"]


@CHECKS.add(
    "univariate_numeric",
    f"""WITH modes AS (SELECT "column", min(value) AS mode, count(*) AS mode_tie_count, max(cnt) AS mode_count
                       FROM ({union(MODES, DOC_NUMBERS, source=LABELLED)}) GROUP BY 1),
        outl AS ({outlier_sql(LABELLED, DOC_NUMBERS, "both")}),
        summ AS ({union(
            '''SELECT '<c>' AS "column", count(*) AS n, count(*) - count("<c>") AS n_missing,
                      round((count(*) - count("<c>")) / count(*), 6) AS missing_pct,
                      round(avg("<c>"), 6) AS mean, round(quantile_cont("<c>"::DOUBLE, 0.5), 6) AS median,
                      round(stddev_samp("<c>"::DOUBLE), 6) AS std,
                      quantile_cont("<c>"::DOUBLE, 0.75) - quantile_cont("<c>"::DOUBLE, 0.25) AS iqr,
                      quantile_cont("<c>"::DOUBLE, 0.25) AS q1, quantile_cont("<c>"::DOUBLE, 0.75) AS q3,
                      min("<c>")::DOUBLE AS min, max("<c>")::DOUBLE AS max FROM <source>''',
            DOC_NUMBERS, source=LABELLED)})
        SELECT s.*, mode, mode::BIGINT::VARCHAR AS mode_text, mode_tie_count, mode_count, outlier_count AS n_outliers
        FROM summ s JOIN modes m ON s."column" = m."column" JOIN outl o ON s."column" = o."column" """,
)
def univariate_numeric(spark, sf_dir):
    return rounded(describe.univariate_numeric(labelled(spark, sf_dir)))


@CHECKS.add("mode_ties", union(MODES, ["user_id", "value"], source="events"))
def mode_ties(spark, sf_dir):
    return describe.mode_ties(table(spark, sf_dir, "events"), ["user_id", "value"])


COUNTS = """SELECT '<c>' AS "column", "<c>"::VARCHAR AS value, "<c>" IS NULL AS is_missing, count(*) AS count,
    round(count(*) / sum(count(*)) OVER (), 6) AS share FROM <source> GROUP BY "<c>" """


@CHECKS.add(
    "value_counts",
    f"""SELECT value, is_missing, count, share
        FROM ({COUNTS.replace("<c>", "quality").replace("<source>", LABELLED)})""",
)
def value_counts(spark, sf_dir):
    return rounded(describe.value_counts(labelled(spark, sf_dir), "quality"))


@CHECKS.add("category_counts", union(COUNTS, ["lang", "source"], source="documents"))
def category_counts(spark, sf_dir):
    return rounded(describe.category_counts(table(spark, sf_dir, "documents"), ["lang", "source"]))


@CHECKS.add(
    "univariate_categorical",
    union(
        """SELECT '<c>' AS "column", count(*) AS n, count(*) - count("<c>") AS n_missing,
                  round((count(*) - count("<c>")) / count(*), 6) AS missing_pct,
                  count(DISTINCT "<c>") AS n_unique, any_value(mode) AS mode,
                  any_value(mode_count) AS mode_count, any_value(ties) AS mode_tie_count
           FROM <source>, (SELECT min(v) AS mode, max(k) AS mode_count, count(*) AS ties FROM
               (SELECT "<c>" AS v, count(*) AS k FROM <source> WHERE "<c>" IS NOT NULL GROUP BY 1
                QUALIFY count(*) = max(count(*)) OVER ()))""",
        ["role", "text"],
        source="conversations",
    ),
)
def univariate_categorical(spark, sf_dir):
    """Whole texts are counted as values."""
    return rounded(
        describe.univariate_categorical(table(spark, sf_dir, "conversations"), ["role", "text"])
    )


TEXT_SUMMARY = """SELECT '<c>' AS "column", 'categorical' AS kind, count(*) AS n, count(*) - count("<c>") AS n_missing,
    round((count(*) - count("<c>")) / count(*), 6) AS missing_pct, any_value(mode) AS mode,
    any_value(mode_count) AS mode_count, any_value(ties) AS mode_tie_count, count(DISTINCT "<c>") AS n_unique,
    NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS q1, NULL::DOUBLE AS median,
    NULL::DOUBLE AS q3, NULL::DOUBLE AS max, NULL::DOUBLE AS iqr, NULL::BIGINT AS n_outliers
    FROM <source>, (SELECT min(v) AS mode, max(k) AS mode_count, count(*) AS ties FROM
        (SELECT "<c>" AS v, count(*) AS k FROM <source> WHERE "<c>" IS NOT NULL GROUP BY 1
         QUALIFY count(*) = max(count(*)) OVER ()))"""


@CHECKS.add(
    "univariate",
    f"""{union(TEXT_SUMMARY, ["lang", "source"], source=LABELLED)}
        UNION ALL SELECT "column", 'numeric', n, n_missing, missing_pct, mode_text, mode_count, mode_tie_count, NULL,
               mean, std, min, q1, median, q3, max, iqr, n_outliers FROM ({CHECKS[0].sql})""",
)
def univariate(spark, sf_dir):
    """All columns of a table in one result."""
    return rounded(describe.univariate(labelled(spark, sf_dir)))


@CHECKS.add(
    "bivariate_numeric",
    f"""SELECT 'l_extendedprice' AS x, 'discount' AS y, count(*) AS n_complete,
               round(corr(l_extendedprice, discount), 6) AS correlation,
               round(covar_samp(l_extendedprice, discount), 6) AS covariance
        FROM {PRICED} WHERE discount IS NOT NULL""",
)
def bivariate_numeric(spark, sf_dir):
    return rounded(describe.bivariate_numeric(priced(spark, sf_dir), "l_extendedprice", "discount"))


@CHECKS.add(
    "group_summary",
    """SELECT event_type AS category, count(value) AS count, round(avg(value), 6) AS mean,
              round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std,
              min(value) AS min, max(value) AS max
       FROM events GROUP BY event_type""",
)
def group_summary(spark, sf_dir):
    return rounded(describe.group_summary(table(spark, sf_dir, "events"), "value", "event_type"))


@CHECKS.add(
    "bivariate_dispatch",
    f"""SELECT quality AS category, count(*) AS count, round(avg(n_chars), 6) AS mean,
               quantile_cont(n_chars::DOUBLE, 0.5) AS median, round(stddev_samp(n_chars::DOUBLE), 6) AS std,
               min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max
        FROM (SELECT n_chars, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS quality FROM {LABELLED})
        WHERE quality IS NOT NULL GROUP BY quality""",
)
def bivariate_dispatch(spark, sf_dir):
    """The category comes first here; rows without one are left out."""
    docs = labelled(spark, sf_dir).selectExpr(
        "n_chars", "CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS quality"
    )
    return rounded(describe.bivariate(docs, "quality", "n_chars"))


CELLS = f"""grid AS (SELECT x.lang AS x, y.quality AS y
                     FROM (SELECT DISTINCT lang FROM documents) x, (SELECT DISTINCT quality FROM {LABELLED}) y),
    cells AS (SELECT g.x, g.y, count(d.doc_id) AS count FROM grid g LEFT JOIN {LABELLED} d
              ON d.lang = g.x AND d.quality IS NOT DISTINCT FROM g.y GROUP BY g.x, g.y)"""


@CHECKS.add("contingency_counts", f"WITH {CELLS} SELECT x, y, count FROM cells")
def contingency_counts(spark, sf_dir):
    """Unlabelled documents are a level of their own."""
    return describe.contingency_counts(labelled(spark, sf_dir), "lang", "quality")


@CHECKS.add(
    "contingency_proportions",
    f"WITH {CELLS} SELECT x, y, round(count / sum(count) OVER (), 6) AS proportion FROM cells",
)
def contingency_proportions(spark, sf_dir):
    return rounded(describe.contingency_proportions(labelled(spark, sf_dir), "lang", "quality"))


@CHECKS.add(
    "contingency_expected",
    f"""WITH {CELLS} SELECT x, y, count,
        round(sum(count) OVER (PARTITION BY x) * sum(count) OVER (PARTITION BY y)
              / sum(count) OVER (), 6) AS expected FROM cells""",
)
def contingency_expected(spark, sf_dir):
    return rounded(describe.contingency_expected(labelled(spark, sf_dir), "lang", "quality"))


@CHECKS.add(
    "contingency_cells",
    "SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS count FROM orders GROUP BY 1, 2",
)
def contingency_cells(spark, sf_dir):
    return describe.contingency_cells(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


CORRELATED = ["l_quantity", "l_extendedprice", "discount", "tax"]


@CHECKS.add(
    "correlation_matrix",
    "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr("{a}", "{b}"), 6) AS correlation FROM {PRICED}"""
        for a, b in product(CORRELATED, CORRELATED)
    ),
)
def correlation_matrix(spark, sf_dir):
    """Each pair uses the rows where both are present."""
    return rounded(describe.correlation_matrix(priced(spark, sf_dir), CORRELATED))


# Sixteen columns, most with missing values: more pairs than one aggregate holds.
WIDE = {
    f"v{k}": f"CASE WHEN (l_orderkey + {k}) % {k + 3} = 0 AND {k} > 2 THEN NULL"
    f" ELSE l_extendedprice * {k + 1} % 1009 + l_quantity * {k} END"
    for k in range(16)
}


@CHECKS.add(
    "correlation_wide",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_complete,
                   round(corr({a}, {b}), 6) AS correlation
            FROM (SELECT {', '.join(f'{text} AS {c}' for c, text in WIDE.items())} FROM lineitem)"""
        for i, a in enumerate(WIDE) for b in list(WIDE)[i + 1 :]
    ),
)
def correlation_wide(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(*[f"{text} AS {c}" for c, text in WIDE.items()])
    return rounded(describe.correlation_pairs(lines))
