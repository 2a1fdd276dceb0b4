"""Hints about fitness for modelling: balance, identifiers, leakage, types, missing patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.columns import (
    TEXT,
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
from plumbline.functions.parsing import DOUBLE_TEXT
from plumbline.operators.profile import column_profile
from plumbline.plans.draw import exactly
from plumbline.plans.groups import beside
from plumbline.plans.levels import column_levels
from plumbline.plans.per_column import wide_to_long
from plumbline.session import stage

# Fixed values of the hints.
IMBALANCE_SHARE = 0.7
ID_UNIQUE_SHARE = 0.95
MANY_CATEGORIES_SHARE = 0.5
LEAKAGE_CORRELATION = 0.98
LEAKAGE_EXPLAINED = 0.8  # a column that explains this share of the target's entropy
UUID_PATTERN = "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """``class, count, share, entropy, is_imbalanced`` over the rows that have a class.

    Entropy is in nats. Imbalanced means that the largest class passes 70 %.
    """
    df = present(df)
    target = resolve(df, target)
    classes = (
        df.filter(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    total = classes.agg(F.sum("count")).scalar()
    shares = classes.withColumn("share", F.col("count") / total)
    entropy = shares.agg(-F.sum(F.col("share") * F.log("share"))).scalar()
    largest = shares.agg(F.max("share")).scalar()
    return shares.select(
        "class", "count", "share", entropy.alias("entropy"),
        (largest > IMBALANCE_SHARE).alias("is_imbalanced"),
    )


def id_like_columns(df: DataFrame) -> DataFrame:
    """Per countable column: how unique it is, and whether it looks like an identifier.

    ``is_sequential`` holds for integers without gaps or repeats, ``is_uuid`` when every
    value has the form of a UUID, ``has_many_categories`` for texts that are more than
    half unique.
    """
    df = present(df)
    kinds = families(df)
    columns = [c for c in df.columns if kinds[c] != "other"]

    nothing = "max(CAST(NULL AS DECIMAL(38,0)))"
    names = {c: quoted(c) for c in columns}
    span = wide_to_long(
        df,
        columns,
        {
            "span": [
                f"CAST(max({n}) AS DECIMAL(38,0)) - min({n}) + 1" if kinds[c] == "integral" else nothing
                for c, n in names.items()
            ],
            "n_uuid": [
                f"count_if({n} RLIKE {sql_text(UUID_PATTERN)})" if kinds[c] == "text" else "max(0L)"
                for c, n in names.items()
            ],
        },
    )
    profile = column_profile(df, columns)
    # One row per column on either side.
    return profile.join(F.broadcast(span.drop("cid")), "column").selectExpr(
        "column",
        "n_unique",
        "coalesce(try_divide(n_unique, n_rows - n_missing), 0D) AS unique_share",
        "coalesce(is_all_unique AND span = n_unique, false) AS is_sequential",
        "n_uuid > 0 AND n_uuid = n_rows - n_missing AS is_uuid",
        f"coalesce(try_divide(n_unique, n_rows - n_missing), 0D) > {ID_UNIQUE_SHARE}D AS is_id_like",
        "family = 'text' AND coalesce(try_divide(n_unique, n_rows - n_missing), 0D)"
        f" > {MANY_CATEGORIES_SHARE}D AS has_many_categories",
    )


def leakage_hints(
    df: DataFrame, target: str, columns: list[str] | None = None,
    limit: float = LEAKAGE_CORRELATION,
) -> DataFrame:
    """``column, correlation`` of numeric columns that nearly determine a numeric target.

    A column or target with an infinite value has no correlation, and gives no hint.
    """
    df = present(df)
    target = require_numeric(df, target)
    others = [c for c in numeric_columns(df, columns) if c != target]
    measured = _with_target(target, others)
    if not measured:
        raise ValueError("there is no other numeric column")
    long = wide_to_long(df, others, {"correlation": measured})
    return long.filter(f"abs(correlation) > {limit}D").select("column", "correlation")


def leakage_scores(
    df: DataFrame, target: str, columns: list[str] | None = None, bins: int = 32,
    limit: float = LEAKAGE_EXPLAINED, exact: bool = False,
) -> DataFrame:
    """``column, n_levels, target_entropy, conditional_entropy, explained, is_leak`` of every column.

    How much of the target's entropy (in nats) each column of any type explains, also where
    the relation is neither linear nor monotone. Numbers are cut at ``bins`` quantiles, a
    missing value is a level of its own, rows without a target are left out. The conditional
    entropy is that of predicting every row from the others of its level, with the target's
    shares as one row of prior: a level seen once explains nothing, so identifiers do not
    look like leaks, as they would with plain counts. It never falls below 0; where a
    column misleads, ``explained`` is 0. A target with one level has entropy 0 and NULL
    in ``explained``. Cells of the contingency tables are counted in one scan, combined
    in the task, and written; levels and target classes may be as many as there are rows.
    """
    df = present(df)
    target = resolve(df, target)
    kinds = families(df)
    others = [c for c in resolve_all(df, columns) if c != target and kinds[c] != "other"]
    if not others or kinds[target] == "other":
        raise ValueError("leakage needs a target and another column whose values can be counted")
    rows = df.filter(col(target).isNotNull())
    levels = column_levels(rows, [target, *others], bins, exact)
    listed = ", ".join(levels.texts[c] for c in others)
    cells = stage(
        rows.selectExpr(f"{levels.texts[target]} AS y", f"posexplode(array({listed})) AS (cid, level)")
        .groupBy("cid", "level", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    classes = cells.filter("cid = 0").groupBy("y").agg(F.sum("n").alias("n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    classes = stage(classes.withColumn("share", F.col("n") / F.lit(float(max(1, total)))))
    entropy = classes.agg(-F.sum(F.col("share") * F.log("share"))).first()[0] or 0.0
    told = beside(cells.withColumnRenamed("n", "found"), ["y"], classes).groupBy("cid").agg(
        F.sum(F.col("found") * F.log(F.col("found") - 1 + F.col("share"))).alias("told")
    )
    spread = (
        cells.groupBy("cid", "level").agg(F.sum("n").alias("n"))
        .groupBy("cid").agg(F.count(F.lit(1)).alias("n_levels"), F.sum(F.col("n") * F.log("n")).alias("spread"))
    )
    names = ", ".join(sql_text(c) for c in others)
    # One row per column on either side.
    return told.join(F.broadcast(spread), "cid").selectExpr(
        f"array({names})[cid] AS column", "n_levels", f"{sql_double(entropy)} AS target_entropy",
        f"greatest(0D, (spread - told) / {total}) AS conditional_entropy",
    ).selectExpr(
        "*", "IF(target_entropy > 0, greatest(0D, 1 - conditional_entropy / target_entropy), NULL) AS explained"
    ).selectExpr("*", f"coalesce(explained >= {sql_double(limit)}, false) AS is_leak")


def _with_target(target: str, others: list[str]) -> list[str]:
    y = number(target)
    return [
        f"nanvl(try_divide(covar_samp({number(c)}, {y}),"
        f" stddev_samp({number(c)}) FILTER (WHERE {y} IS NOT NULL)"
        f" * stddev_samp({y}) FILTER (WHERE {number(c)} IS NOT NULL)), CAST(NULL AS DOUBLE))"
        for c in others
    ]


def type_consistency(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, n, numeric_pct, date_pct``: how much of a text column reads as another type.

    A plain number is a number, even if it could be a year.
    """
    columns = resolve_all(df, columns)
    columns = [c for c in columns if isinstance(df.schema[c].dataType, TEXT)]
    names = [quoted(c) for c in columns]
    long = wide_to_long(
        df,
        columns,
        {
            "n": [f"count({c})" for c in names],
            "n_numeric": [f"count_if({c} RLIKE {sql_text(DOUBLE_TEXT)})" for c in names],
            "n_date": [f"count_if(NOT {c} RLIKE {sql_text(DOUBLE_TEXT)} AND try_cast({c} AS TIMESTAMP_NTZ) IS NOT NULL)"
                for c in names],
        },
    )
    return long.selectExpr(
        "column", "n", "n_numeric / greatest(1, n) AS numeric_pct",
        "n_date / greatest(1, n) AS date_pct",
    )


def inconsistent_values(df: DataFrame, column: str) -> DataFrame:
    """``value, count`` of the texts that do not read as numbers in a column that mostly does."""
    column = resolve(df, column)
    return (
        df.filter(col(column).isNotNull() & ~col(column).rlike(DOUBLE_TEXT))
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def row_missingness(df: DataFrame) -> DataFrame:
    """``n_missing, n_rows``: how many rows miss that many columns."""
    df = present(df)
    flags = " + ".join(f"CAST({quoted(c)} IS NULL AS BIGINT)" for c in df.columns)
    return df.groupBy(F.expr(flags).alias("n_missing")).agg(F.count(F.lit(1)).alias("n_rows"))


def missing_patterns(df: DataFrame) -> DataFrame:
    """``pattern, n_rows``: which columns are missing together, 1 for missing, in column order."""
    df = present(df)
    bits = ", ".join(f"IF({quoted(c)} IS NULL, '1', '0')" for c in df.columns)
    return df.groupBy(F.expr(f"concat({bits})").alias("pattern")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def stratified_sample(
    df: DataFrame, target: str, fractions: dict[object, float], seed: int = 0,
    key: list[str] | None = None,
) -> DataFrame:
    """A seeded sample with its own fraction per class; unnamed classes are left out.

    A row is drawn by a digest of seed and ``key`` (all columns if none is given), so every
    cluster draws the same rows, and rows with equal keys are drawn together.
    """
    target = resolve(df, target)
    share = F.lit(0.0)
    for value, fraction in fractions.items():
        share = F.when(col(target).eqNullSafe(F.lit(value)), F.lit(float(fraction))).otherwise(share)
    return df.filter(drawn(resolve_all(df, key), seed) < share)


def sized_sample(
    df: DataFrame, target: str, sizes: int | dict[object, int], seed: int = 0, key: list[str] | None = None
) -> DataFrame:
    """A seeded sample of exactly so many rows per class, or all rows of a class that has fewer.

    ``sizes`` is one number for every class, a missing one included, or a number for each
    named class; unnamed ones are left out. A row's place is a digest of seed and ``key`` (all
    columns if none is given), so every cluster and partitioning draws the same rows, and a
    larger size keeps those of a smaller one. Rows with equal keys are told apart by their
    other columns; of rows equal in all columns any may be taken, as they are the same.
    No class is gathered or ordered.
    """
    target = resolve(df, target)
    numbers = sizes.values() if isinstance(sizes, dict) else [sizes]
    if any(int(n) != n or n < 0 for n in numbers):
        raise ValueError("sizes must be whole numbers, 0 or more")
    wanted = F.lit(0) if isinstance(sizes, dict) else F.lit(int(sizes))
    for value, n in sizes.items() if isinstance(sizes, dict) else ():
        wanted = F.when(col(target).eqNullSafe(F.lit(value)), F.lit(int(n))).otherwise(wanted)
    group = F.coalesce(F.concat(F.lit("="), col(target).cast("string")), F.lit(""))
    kinds = families(df)
    plain = [col(c).cast("string") for c in df.columns if kinds[c] != "other"]
    rest = F.xxhash64(*plain) if plain else F.lit(0)
    return exactly(df, group, wanted, drawn(resolve_all(df, key), seed), rest)
