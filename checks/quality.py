"""Profiles, outliers, readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    LABELLED,
    PRICED,
    Checks,
    labelled,
    outlier_sql,
    priced,
    rounded,
    rounded_outlier_sql,
    table,
    union,
)
from checks.sources import DOCS, TYPE_RULE, typed
from plumbline.operators import outliers, profile, readiness, states

CHECKS = Checks()

LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
DOC_NUMBERS = ["doc_id", "n_chars", "quality", "toxic"]


@CHECKS.add("dataset_shape", "SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def dataset_shape(spark, sf_dir):
    return profile.dataset_shape(table(spark, sf_dir, "lineitem"))


@CHECKS.add(
    "missing_profile",
    union(
        """SELECT '<c>' AS "column", count(*) AS n_rows, count(*) - count("<c>") AS n_missing,
                  round((count(*) - count("<c>")) / greatest(1, count(*)), 6) AS missing_pct
           FROM <source>""",
        ["l_orderkey", "l_quantity", "l_extendedprice", "discount", "tax", "l_returnflag", "l_linestatus"],
        source=PRICED,
    ),
)
def missing_profile(spark, sf_dir):
    return rounded(profile.missing_profile(priced(spark, sf_dir)).drop("cid"))


@CHECKS.add(
    "distinct_counts",
    union(
        'SELECT \'<c>\' AS "column", count(DISTINCT "<c>") AS n_unique FROM <source>',
        [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"],
        source="lineitem",
    ),
)
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "lineitem")).select("column", "n_unique")


@CHECKS.add(
    "duplicate_rows",
    """SELECT count(*) AS n_rows, count(*) - count(DISTINCT text) AS duplicate_count,
              round((count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_pct FROM documents""",
)
def duplicate_rows(spark, sf_dir):
    """Whole texts are compared, through digests of a fixed width."""
    return rounded(profile.duplicate_rows(table(spark, sf_dir, "documents").select("text")))


@CHECKS.add(
    "dataset_issues",
    """SELECT printf('Dataset has %d duplicate rows (%.1f%% of all rows).', dup, 100.0 * dup / r) AS issue
       FROM (SELECT count(*) AS r, count(*) - count(DISTINCT text) AS dup FROM documents) WHERE dup > 0""",
)
def dataset_issues(spark, sf_dir):
    return profile.dataset_issues(table(spark, sf_dir, "documents").select("text"))


@CHECKS.add(
    "column_flags",
    union(
        """SELECT '<c>' AS "column", count(DISTINCT "<c>") AS n_unique,
                  count(DISTINCT "<c>") <= 1 AS is_constant,
                  count(DISTINCT "<c>") = count("<c>") AS is_all_unique FROM <source>""",
        ["s_suppkey", "s_name", "s_nationkey", "s_acctbal", "kind"],
        source="(SELECT *, 'supplier' AS kind FROM supplier)",
    ),
)
def column_flags(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").withColumn("kind", F.lit("supplier"))
    return profile.column_flags(suppliers)


ISSUES = """
    SELECT "column", 'High missingness: ' || printf('%.1f%%', 100.0 * m / r)
           || ' of values are missing.' AS issue FROM facts WHERE m / r > 0.3
    UNION ALL
    SELECT "column", 'Some missing values: ' || printf('%.1f%%', 100.0 * m / r)
           || ' of values are missing.' FROM facts WHERE m > 0 AND m / r <= 0.3
    UNION ALL
    SELECT "column", 'Column is constant (only one unique non-null value).' FROM facts WHERE u <= 1
"""
MIXED = f"(SELECT * FROM (SELECT discount, tax, 1 AS unit FROM {PRICED}))"


@CHECKS.add(
    "column_issues",
    f"""WITH facts AS (
            {typed(DOCS, LABELLED)} UNION ALL
            {typed({c: ("", "number") for c in ("discount", "tax", "unit")}, MIXED)}
        ) {ISSUES}""",
)
def column_issues(spark, sf_dir):
    prices = priced(spark, sf_dir).selectExpr("discount", "tax", "1 AS unit")
    return profile.column_issues(labelled(spark, sf_dir)).unionByName(profile.column_issues(prices))


SUMMARY = """SELECT '<c>' AS "column", count("<c>") AS n, count(*) - count("<c>") AS n_missing,
    round(avg("<c>"::DOUBLE), 6) AS mean, round(stddev_samp("<c>"::DOUBLE), 6) AS std,
    round(min("<c>"::DOUBLE), 6) AS min, round(quantile_cont("<c>"::DOUBLE, 0.25), 6) AS q1,
    round(quantile_cont("<c>"::DOUBLE, 0.5), 6) AS median,
    round(quantile_cont("<c>"::DOUBLE, 0.75), 6) AS q3, round(max("<c>"::DOUBLE), 6) AS max,
    round(quantile_cont("<c>"::DOUBLE, 0.75) - quantile_cont("<c>"::DOUBLE, 0.25), 6) AS iqr
    FROM <source>"""


@CHECKS.add("numeric_summary", union(SUMMARY.replace(", 6)", ", 5)"), LINE_NUMBERS, source="lineitem"))
def numeric_summary(spark, sf_dir):
    return rounded(outliers.numeric_summary(table(spark, sf_dir, "lineitem")), 5)


def _events_and_documents(spark, sf_dir, method):
    events = outliers.outlier_counts(table(spark, sf_dir, "events"), ["value", "user_id"], method)
    return rounded(events.unionByName(outliers.outlier_counts(labelled(spark, sf_dir), None, method)))


def _both_sql(method):
    return (
        rounded_outlier_sql("events", ["value", "user_id"], method)
        + " UNION ALL "
        + rounded_outlier_sql(LABELLED, DOC_NUMBERS, method)
    )


for _name, _method in (("outliers_iqr", "iqr"), ("outliers_zscore", "zscore"), ("outliers_both", "both")):
    CHECKS.add(_name, _both_sql(_method))(
        lambda spark, sf_dir, method=_method: _events_and_documents(spark, sf_dir, method)
    )

FENCED = """SELECT event_id, user_id, event_type, value FROM events,
    (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
            avg(value) AS m, stddev_samp(value) AS s FROM events)
    WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) OR abs((value - m) / s) > 3"""


@CHECKS.add("outlier_rows", FENCED)
def outlier_rows(spark, sf_dir):
    """Every flagged row, not a preview."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return outliers.outlier_rows(events, "value")


@CHECKS.add(
    "outlier_preview",
    f"""WITH flagged AS ({FENCED})
        SELECT event_id AS key, value, (SELECT count(*) FROM flagged) AS outlier_count,
               (SELECT count(*) FROM flagged) > 20 AS truncated
        FROM flagged ORDER BY value, event_id LIMIT 20""",
)
def outlier_preview(spark, sf_dir):
    return outliers.outlier_preview(table(spark, sf_dir, "events"), "value", "event_id")


HINT = """'`' || "column" || '` >= ' || printf('%.4g', lower_bound) || ' and `' || "column"
          || '` <= ' || printf('%.4g', upper_bound)"""


@CHECKS.add(
    "outlier_metadata",
    f"""SELECT "column", n, outlier_count, round(outlier_pct, 6) AS outlier_pct, method,
               round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
               round(min_outlier, 6) AS min_outlier, round(max_outlier, 6) AS max_outlier,
               {HINT} AS suggested_filter
        FROM ({outlier_sql(LABELLED, DOC_NUMBERS, "both")}) WHERE outlier_count > 0""",
)
def outlier_metadata(spark, sf_dir):
    return rounded(outliers.outlier_metadata(labelled(spark, sf_dir)))


@CHECKS.add(
    "suggested_actions",
    f"""SELECT "column", CASE WHEN outlier_pct > 0.15
            THEN 'High outlier rate (' || printf('%.1f%%', 100 * outlier_pct) || ') in ''' || "column"
                 || ''': Consider removing values outside [' || printf('%.4g', lower_bound) || ', '
                 || printf('%.4g', upper_bound) || ']'
            ELSE 'Found ' || outlier_count || ' outliers in ''' || "column" || ''': Filter: ' || {HINT}
            END AS action
        FROM ({outlier_sql(LABELLED, DOC_NUMBERS, "both")}) WHERE outlier_count > 0""",
)
def suggested_actions(spark, sf_dir):
    return outliers.suggested_actions(outliers.outlier_metadata(labelled(spark, sf_dir)))


@CHECKS.add(
    "outlier_options",
    f"""WITH meta AS (SELECT * FROM ({outlier_sql(LABELLED, DOC_NUMBERS, "both")}) WHERE outlier_count > 0)
        SELECT 'all' AS id, 'Remove ALL outliers (' || sum(outlier_count)::BIGINT
               || ' total across all columns)' AS description, NULL::BIGINT AS estimated_rows,
               NULL::DOUBLE AS lower_bound, NULL::DOUBLE AS upper_bound FROM meta HAVING count(*) > 0
        UNION ALL
        SELECT "column", 'Remove ' || outlier_count || ' outliers from ''' || "column" || ''' ('
               || printf('%.1f%%', 100 * outlier_pct) || ' of values) - keep values in ['
               || printf('%.4g', lower_bound) || ', ' || printf('%.4g', upper_bound) || ']',
               outlier_count, round(lower_bound, 6), round(upper_bound, 6) FROM meta""",
)
def outlier_options(spark, sf_dir):
    return rounded(outliers.outlier_options(outliers.outlier_metadata(labelled(spark, sf_dir))))


# ---- readiness ----------------------------------------------------------------

# Without the key, some documents are copies of each other in every column.
UNKEYED = f"(SELECT lang, source, n_chars, quality, toxic FROM {LABELLED})"
UNKEYED_COLUMNS = {c: DOCS[c] for c in ("lang", "source", "n_chars", "quality", "toxic")}


def unkeyed(spark, sf_dir):
    return labelled(spark, sf_dir).drop("doc_id")


def scored_sql(columns: dict[str, tuple[str, str]], source: str, numbers: list[str]) -> str:
    """The readiness of ``source`` as the common table ``scored``."""
    return f"""
    WITH facts AS ({typed(columns, source)}),
    outl AS ({outlier_sql(source, numbers, "both")}),
    dup AS (SELECT count(*) AS r, (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS d
            FROM {source}),
    ratios AS (
        SELECT (SELECT avg(m / r) FROM facts) AS avg_missing,
               (SELECT (r - d) / r FROM dup) AS duplicate_pct,
               (SELECT r FROM dup) AS n_rows,
               (SELECT avg((u <= 1)::INT) FROM facts) AS constant_ratio,
               (SELECT avg((m / r > 0.4)::INT) FROM facts) AS high_missing_ratio,
               (SELECT sum(outlier_count) / sum(outlier_count + 1) FROM outl) AS outlier_density,
               (SELECT sum(outlier_count) / sum(n) FROM outl) AS outlier_share
    ),
    parts AS (
        SELECT *, round(greatest(0.0, 100 - 120 * avg_missing), 2) AS missingness,
               round(greatest(0.0, 100 - 150 * duplicate_pct), 2) AS duplicates,
               round(greatest(0.0, 100 - 200 * constant_ratio), 2) AS constants,
               round(greatest(0.0, 100 - 250 * high_missing_ratio), 2) AS high_missing_columns,
               round(greatest(0.0, 100 - 80 * outlier_density), 2) AS outliers
        FROM ratios
    ),
    scored AS (
        SELECT *, round((missingness + duplicates + constants + high_missing_columns + outliers) / 5, 2)
                  AS overall FROM parts
    )
"""


SCORED = scored_sql(UNKEYED_COLUMNS, UNKEYED, ["n_chars", "quality", "toxic"])


@CHECKS.add(
    "readiness_score",
    SCORED
    + """SELECT n_rows, round(duplicate_pct, 6) AS duplicate_pct, round(avg_missing, 6) AS avg_missing,
                round(constant_ratio, 6) AS constant_ratio,
                round(high_missing_ratio, 6) AS high_missing_ratio,
                round(outlier_density, 6) AS outlier_density, round(outlier_share, 6) AS outlier_share,
                missingness, duplicates, constants, high_missing_columns, outliers, overall FROM scored""",
)
def readiness_score(spark, sf_dir):
    return rounded(readiness.readiness_score(unkeyed(spark, sf_dir)).drop("notes"))


@CHECKS.add(
    "readiness_notes",
    SCORED
    + " UNION ALL ".join(
        f"SELECT '{text}' AS note FROM scored WHERE {ratio} > {limit}"
        for ratio, limit, text in readiness.NOTES
    ),
)
def readiness_notes(spark, sf_dir):
    scored = readiness.readiness_score(unkeyed(spark, sf_dir))
    return scored.select(F.explode("notes").alias("note"))


@CHECKS.add(
    "readiness_band",
    SCORED
    + """SELECT overall, CASE WHEN overall >= 90 THEN 'Ready' WHEN overall >= 75 THEN 'Minor fixes needed'
                WHEN overall >= 50 THEN 'Needs work' ELSE 'Not ready' END AS band,
                round(duplicate_pct, 6) AS duplicate_pct,
                round((SELECT max(m / r) FROM facts), 6) AS worst_missing,
                (SELECT count(*) FROM facts WHERE u <= 1) AS n_constant,
                overall >= 85 AND duplicate_pct <= 0.01 AND (SELECT max(m / r) FROM facts) <= 0.4
                AND (SELECT count(*) FROM facts WHERE u <= 1) = 0 AS is_ready FROM scored""",
)
def readiness_band(spark, sf_dir):
    return rounded(readiness.exit_test(readiness.quality_report(unkeyed(spark, sf_dir))))


@CHECKS.add(
    "quality_report",
    f"""WITH facts AS ({typed(DOCS, LABELLED)}),
        outl AS ({rounded_outlier_sql(LABELLED, DOC_NUMBERS, "both")}),
        summ AS ({union(SUMMARY, DOC_NUMBERS, source=LABELLED)})
        SELECT f."column", dtype, r AS n_rows, m AS n_missing, round(m / greatest(1, r), 6) AS missing_pct,
               u AS n_unique, {TYPE_RULE} AS semantic_type, u <= 1 AS is_constant, u = r - m AS is_all_unique,
               mean, std, min, q1, median, q3, max, iqr, outlier_count, outlier_pct,
               lower_bound, upper_bound, min_outlier, max_outlier
        FROM facts f LEFT JOIN summ s ON f."column" = s."column" LEFT JOIN outl o ON f."column" = o."column" """,
)
def quality_report(spark, sf_dir):
    report = readiness.quality_report(labelled(spark, sf_dir))
    return rounded(report.columns.drop("position", "family"))


@CHECKS.add(
    "column_report",
    f"""WITH facts AS ({typed({"value": ("double", "number")}, "events")}),
        outl AS ({outlier_sql("events", ["value"], "both")}), summ AS ({union(SUMMARY, ["value"], source="events")})
        SELECT 0::INTEGER AS position, f."column", dtype, 'fractional' AS family, r AS n_rows, m AS n_missing,
               round(m / greatest(1, r), 6) AS missing_pct, u AS n_unique, {TYPE_RULE} AS semantic_type,
               u <= 1 AS is_constant, u = r - m AS is_all_unique,
               mean, std, min, q1, median, q3, max, iqr, outlier_count, round(outlier_pct, 6) AS outlier_pct,
               round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
               round(min_outlier, 6) AS min_outlier, round(max_outlier, 6) AS max_outlier
        FROM facts f JOIN summ s ON f."column" = s."column" JOIN outl o ON f."column" = o."column" """,
)
def column_report(spark, sf_dir):
    return rounded(profile.column_report(table(spark, sf_dir, "events"), "value"))


STATE_PARTS = 5


@CHECKS.add(
    "merged_profile",
    union(
        """SELECT '<c>' AS "column", count(*) AS n_rows, count(*) - count("<c>") AS n_missing,
                  round((count(*) - count("<c>")) / count(*), 6) AS missing_pct, round(avg("<c>"), 6) AS mean,
                  round(stddev_samp("<c>"), 6) AS std, min("<c>")::DOUBLE AS min, max("<c>")::DOUBLE AS max FROM <source>""",
        ["l_quantity", "l_extendedprice", "discount", "tax"],
        source=PRICED,
    ),
)
def merged_profile(spark, sf_dir):
    """The exact measures of a table whose parts were profiled apart."""
    lines = priced(spark, sf_dir)
    parts = [
        states.profile_state(lines.filter(f"l_orderkey % {STATE_PARTS} = {i}"), ["l_quantity", "l_extendedprice", "discount", "tax"])
        for i in range(STATE_PARTS)
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = states.merged_report(every)
    return rounded(found.select("column", "n_rows", "n_missing", "missing_pct", "mean", "std", "min", "max"))
