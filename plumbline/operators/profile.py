"""Column profiles: missing and distinct values, semantic types, duplicates, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import thresholds as t
from plumbline.columns import (
    col,
    families,
    number,
    present,
    quoted,
    resolve_all,
    sql_text,
)
from plumbline.functions.text import percent
from plumbline.plans.frequency import (
    PRESENT,
    countable,
    row_key,
    value_frequencies,
)
from plumbline.plans.per_column import together, wide_to_long
from plumbline.plans.ranks import column_quantiles, sketched

QUARTILES = [0.25, 0.5, 0.75]


def dataset_shape(df: DataFrame) -> DataFrame:
    """``n_rows, n_columns``."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")
    )


def sample_rows(df: DataFrame, order_by: list[str], n: int = t.SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows by ``order_by``. Spark keeps a top-n per task, not a full sort."""
    return df.orderBy(*[col(c) for c in resolve_all(df, order_by)]).limit(n)


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, n_rows, n_missing, missing_pct``, from one scan without a shuffle of rows."""
    df = present(df)
    columns = resolve_all(df, columns)
    long = wide_to_long(
        df,
        columns,
        {
            "n_rows": ["count(*)" for _ in columns],
            "n_missing": [f"count_if({quoted(c)} IS NULL)" for c in columns],
        },
    )
    return long.selectExpr("*", "n_missing / greatest(1, n_rows) AS missing_pct")


def distinct_counts(
    df: DataFrame, columns: list[str] | None = None, exact: bool = True
) -> DataFrame:
    """``cid, column, n_unique`` over non-missing values.

    Exact counts shuffle every distinct value once, for all columns together.
    ``exact=False`` uses sketches in a single scan instead.
    """
    df = present(df)
    columns = countable(df, resolve_all(df, columns))
    if not exact:
        sketches = [f"approx_count_distinct({quoted(c)})" for c in columns]
        return wide_to_long(df, columns, {"n_unique": sketches})
    return name_columns(distinct_of(value_frequencies(df, columns)), columns)


def distinct_of(freq: DataFrame) -> DataFrame:
    """``cid, n_unique`` from value frequencies."""
    return freq.groupBy("cid").agg(F.expr(f"count_if({PRESENT}) AS n_unique"))


def name_columns(per_column: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``column`` to a table keyed by the place in ``columns``."""
    names = ", ".join(sql_text(c) for c in columns)
    return per_column.selectExpr("*", f"array({names})[cid] AS column")


# The semantic type of a column from its family of types and its counts.
SEMANTIC_TYPE = f"""
    CASE
        WHEN family = 'datetime' THEN 'datetime'
        WHEN family IN ('integral', 'fractional', 'decimal') THEN
            IF(n_unique <= {t.NUMERIC_CATEGORY_MAX}
                   OR n_unique <= {t.NUMERIC_CATEGORY_SHARE}D * n_rows,
               'numeric_categorical', 'numeric')
        WHEN family = 'boolean' THEN 'boolean'
        WHEN family = 'text' THEN
            IF(n_unique <= {t.TEXT_CATEGORY_MAX} AND n_unique <= {t.TEXT_CATEGORY_SHARE}D * n_rows,
               'categorical', 'text')
        ELSE 'unknown'
    END
"""


def schema_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``position, column, dtype, family``, one row per column."""
    kinds = families(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.sparkSession.createDataFrame(
        [(i, c, types[c], kinds[c]) for i, c in enumerate(columns)],
        "position int, column string, dtype string, family string",
    )


def column_measures(
    df: DataFrame, columns: list[str], exact: bool = True, distinct: DataFrame | None = None
) -> DataFrame:
    """One row per column with everything that does not depend on outliers, measured now.

    Counts and moments come from one scan that moves no rows, distinct counts from the
    value frequencies, quartiles from brackets; the three run at the same time. A caller
    that needs the frequencies itself may pass ``distinct``: ``cid, n_unique`` and more
    columns, which are kept.
    """
    kinds = families(df)
    numeric = {c for c in columns if kinds[c] in ("integral", "fractional", "decimal")}

    def moments(aggregate: str) -> list[str]:
        return [
            f"{aggregate}({number(c) if c in numeric else 'CAST(NULL AS DOUBLE)'})" for c in columns
        ]

    measures = {
        "n_rows": ["count(*)" for _ in columns],
        "n_missing": [f"count_if({quoted(c)} IS NULL)" for c in columns],
        "mean": moments("avg"),
        "std": moments("stddev_samp"),
        "min": moments("min"),
        "max": moments("max"),
    }
    scalars = countable(df, columns)
    numbers = [c for c in columns if c in numeric]
    if exact:
        if distinct is None:
            distinct = distinct_of(value_frequencies(df, scalars))
        moved, counted, ranked = together(
            wide_to_long(df, columns, measures).collect,
            distinct.collect,
            lambda: column_quantiles(df, [number(c) for c in numbers], QUARTILES).collect(),
        )
        extras = [f for f in distinct.schema.fields if f.name not in ("cid", "n_unique")]
        found = {scalars[r["cid"]]: r for r in counted}
        quartiles = {numbers[r["cid"]]: r["q"] for r in ranked}
    else:
        measures["n_unique"] = [
            f"approx_count_distinct({quoted(c)})" if c in scalars else "max(CAST(NULL AS BIGINT))"
            for c in columns
        ]
        moved, ranked = together(
            wide_to_long(df, columns, measures).collect, lambda: sketched_quartiles(df, numbers).collect()
        )
        extras = []
        found = {r["column"]: r for r in moved}
        quartiles = {r["column"]: r["q"] for r in ranked}
    moved = {r["column"]: r for r in moved}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = []
    for i, c in enumerate(columns):
        n_unique = None if kinds[c] == "other" else found[c]["n_unique"] if c in found else 0
        own = [moved[c][m] for m in ("n_rows", "n_missing", "mean", "std", "min", "max")]
        more = [found[c][f.name] if c in found else None for f in extras]
        rows.append((c, i, types[c], kinds[c], *own, n_unique, quartiles.get(c), *more))
    schema = (
        "column string, position int, dtype string, family string, n_rows bigint, n_missing bigint,"
        " mean double, std double, min double, max double, n_unique bigint, q array<double>"
    )
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in extras)
    return df.sparkSession.createDataFrame(rows, schema)


def sketched_quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, q`` with quartiles whose ranks are off by about a thousandth.

    Sketches of groups of tasks are merged first and then with each other, so that no
    task merges the sketches of all tasks.
    """
    found = sketched(df, [number(c) for c in columns], [QUARTILES] * len(columns))
    rows = [(c, q) for c, (_, q) in zip(columns, found, strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, q array<double>")


# The profile of a column from its measures.
PROFILE = [
    "position",
    "column",
    "dtype",
    "family",
    "n_rows",
    "n_missing",
    "n_missing / greatest(1, n_rows) AS missing_pct",
    "n_unique",
    f"{SEMANTIC_TYPE} AS semantic_type",
    "coalesce(n_unique <= 1, false) AS is_constant",
    "coalesce(n_unique = n_rows - n_missing, false) AS is_all_unique",
]


def profile_from_measures(measures: DataFrame) -> DataFrame:
    return measures.selectExpr(*PROFILE)


def column_profile(
    df: DataFrame, columns: list[str] | None = None, exact: bool = True
) -> DataFrame:
    """One row per column: type, missing and distinct counts, semantic type, flags.

    Nested and binary columns have no distinct count; their flags are false.
    """
    df = present(df)
    columns = resolve_all(df, columns)
    known = schema_table(df, columns)
    missing = missing_profile(df, columns).select("column", "n_rows", "n_missing")
    uniques = distinct_counts(df, columns, exact).select("column", "n_unique")
    # All three sides have one row per column of the frame.
    out = known.join(F.broadcast(missing), "column").join(F.broadcast(uniques), "column", "left")
    n_unique = "IF(family = 'other', NULL, coalesce(n_unique, 0L))"
    return profile_from_measures(out.withColumn("n_unique", F.expr(n_unique)))


def semantic_types(df: DataFrame) -> DataFrame:
    return column_profile(df).select("column", "dtype", "n_unique", "semantic_type")


def column_flags(df: DataFrame) -> DataFrame:
    return column_profile(df).select("column", "n_unique", "is_constant", "is_all_unique")


def example_values(
    df: DataFrame, columns: list[str] | None = None, n: int = t.EXAMPLE_VALUES
) -> DataFrame:
    """``column, example_values``: the ``n`` smallest distinct values as an array of texts.

    Every scan finds the next value of all columns with one wide aggregate, so there are
    at most ``n`` scans, whatever the columns, and nothing is sorted. ``n`` values per
    column reach the driver.
    """
    df = present(df)
    columns = countable(df, resolve_all(df, columns))
    kinds = families(df)
    found: dict[str, list[str]] = {c: [] for c in columns}
    pending = columns
    for _ in range(n):
        if not pending:
            break
        cells = []
        for i, c in enumerate(pending):
            kind, value = df.schema[c].dataType.simpleString(), quoted(c)
            if kinds[c] == "fractional":
                value = f"IF({value} = 0, CAST(0 AS {kind}), {value})"  # both zeros are one value
            if found[c]:
                value = f"IF({value} > CAST({sql_text(found[c][-1])} AS {kind}), {value}, NULL)"
            cells.append(f"CAST(min({value}) AS STRING) AS v{i}")
        smallest = df.selectExpr(*cells).first()
        more = {c: smallest[i] for i, c in enumerate(pending)}
        pending = [c for c in pending if more[c] is not None]
        for c in pending:
            found[c].append(more[c])
    rows = [(c, values) for c, values in found.items() if values]
    return df.sparkSession.createDataFrame(rows, "column string, example_values array<string>")


def ingest_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The profile shown after reading a file, with example values."""
    profile = column_profile(df, columns)
    examples = example_values(df, columns)
    return profile.join(F.broadcast(examples), "column", "left").select(
        "column", "dtype", "semantic_type", "n_missing", "missing_pct", "n_unique", "example_values"
    )


def missingness_warnings(df: DataFrame) -> DataFrame:
    """``column, warning`` for columns that are missing in more than 30 % of the rows."""
    high = missing_profile(df).filter(f"missing_pct > {t.HIGH_MISSING}D")
    shown = percent("missing_pct")
    return high.selectExpr(
        "column",
        f"concat('Column \\'', column, '\\' has high missingness (', {shown}, ').') AS warning",
    )


def issues_from_profile(profile: DataFrame) -> DataFrame:
    """``column, issue``, one row per issue of a column."""
    # The texts of the issues.
    of_values = f"concat({percent('missing_pct')}, ' of values are missing.')"
    high = t.HIGH_MISSING
    texts = [
        f"IF(missing_pct > {high}D, concat('High missingness: ', {of_values}), NULL)",
        f"IF(missing_pct > 0 AND missing_pct <= {high}D,"
        f" concat('Some missing values: ', {of_values}), NULL)",
        "IF(is_constant, 'Column is constant (only one unique non-null value).', NULL)",
    ]
    return profile.selectExpr("column", f"explode(array_compact(array({', '.join(texts)}))) AS issue")


def column_issues(df: DataFrame) -> DataFrame:
    return issues_from_profile(column_profile(df))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``n_rows, duplicate_count, duplicate_pct``; missing equals missing.

    Long texts and nested values enter the grouping as SHA-256 digests, so a row is
    shuffled at a bounded width, and copies are counted together before the shuffle.
    """
    df = present(df)
    keys = df.selectExpr(*[f"{row_key(f)} AS k{i}" for i, f in enumerate(df.schema.fields)])
    copies = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("copies"))
    return copies.selectExpr(
        "coalesce(sum(copies), 0L) AS n_rows", "coalesce(sum(copies - 1), 0L) AS duplicate_count"
    ).selectExpr("*", "duplicate_count / greatest(1, n_rows) AS duplicate_pct")


def dataset_issues(df: DataFrame) -> DataFrame:
    """``issue``: a line about duplicate rows when there are any."""
    return (
        duplicate_rows(df)
        .filter(F.col("duplicate_count") > 0)
        .selectExpr(
            "concat('Dataset has ', duplicate_count, ' duplicate rows (',"
            f" {percent('duplicate_pct')}, ' of all rows).') AS issue"
        )
    )


def column_report(df: DataFrame, name: str) -> DataFrame:
    """Everything known about one column in one row (numeric measures NULL for other types)."""
    from plumbline.operators.readiness import quality_report

    return quality_report(present(df).select(*[col(c) for c in resolve_all(df, [name])])).columns
