"""Which columns are missing together: closed sets, and how far pairs depend."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.columns import present, quoted, resolve_all, sql_text
from plumbline.session import stage


def _masks(df: DataFrame, columns: list[str], least: float) -> tuple[DataFrame, list[str], int]:
    """``mask, cnt``: rows by the places of their missing columns, of those missing often enough."""
    first = df.selectExpr("count(*) AS n", *[f"count_if({quoted(c)} IS NULL) AS m{i}" for i, c in enumerate(columns)]).first()
    often = [c for i, c in enumerate(columns) if first[f"m{i}"] >= max(1, math.ceil(least * first["n"]))]
    places = ", ".join(f"IF({quoted(c)} IS NULL, {i}, NULL)" for i, c in enumerate(often))
    mask = f"array_compact(array({places}))" if often else "CAST(array() AS array<int>)"
    masks = df.groupBy(F.expr(mask).alias("mask")).agg(F.count(F.lit(1)).alias("cnt"))
    return stage(masks), often, first["n"]


def missing_sets(df: DataFrame, columns: list[str] | None = None, least_share: float = 0.01) -> DataFrame:
    """``pattern, size, n_rows, share``: closed sets of columns that are missing together.

    A set counts the rows that miss all its columns, and maybe others; it is reported if they
    are at least ``least_share`` of all rows, and if no further column is missing in all of
    them. So sets that say the same about the same rows are told once, by the largest.
    ``pattern`` names its columns in their order, joined by `` + ``.

    Rows are first counted by mask, in one scan. Every closed set is made once, from its
    own first columns: a set is extended by one later column and closed over all masks that
    hold it, and dropped if the closure adds an earlier column. One job a level.
    """
    if not 0 < least_share <= 1:
        raise ValueError("least_share must lie in (0, 1]")
    df = present(df)
    masks, names, total = _masks(df, resolve_all(df, columns), least_share)
    spark = df.sparkSession
    least = max(1, math.ceil(least_share * total))
    everywhere = masks.selectExpr("explode(mask) AS c", "cnt").groupBy("c").agg(F.sum("cnt").alias("n"))
    always = sorted(r["c"] for r in everywhere.filter(F.col("n") == total).collect())
    closed = spark.createDataFrame([(always, -1, total)], "columns array<int>, core int, n_rows long")
    found = [closed.filter("size(columns) > 0")]
    holding = masks.selectExpr("explode(mask) AS core", "mask", "cnt")
    while names:
        later = f"filter(sequence(0, {len(names) - 1}), j -> j > core AND NOT array_contains(columns, j))"
        tried = closed.selectExpr("columns AS base", f"explode({later}) AS core")
        held = holding.join(tried, "core").filter("size(array_except(base, mask)) = 0")
        counted = (
            held.selectExpr("base", "core", "explode(mask) AS c", "cnt")
            .groupBy("base", "core", "c").agg(F.sum("cnt").alias("n"))
            .groupBy("base", "core").agg(F.max("n").alias("n_rows"), F.collect_list(F.struct("c", "n")).alias("seen"))
            .filter(F.col("n_rows") >= least)
            .selectExpr("base", "core", "n_rows", "array_sort(transform(filter(seen, s -> s.n = n_rows), s -> s.c)) AS columns")
            .filter("forall(columns, c -> c >= core OR array_contains(base, c))")
        )
        closed = stage(counted.select("columns", "core", "n_rows"))
        if closed.isEmpty():
            break
        found.append(closed)
    listed = ", ".join(map(sql_text, names)) or "''"
    parts = found[0]
    for part in found[1:]:
        parts = parts.unionByName(part)
    return parts.selectExpr(
        f"array_join(transform(columns, c -> array({listed})[c]), ' + ') AS pattern",
        "size(columns) AS size", "n_rows", f"n_rows / {max(1, total)} AS share",
    )


def missing_dependence(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``col_a, col_b, n_a, n_b, n_both, phi`` of each pair of columns with missing values, ``col_a`` first.

    ``phi`` is the correlation of being missing: 1 if they miss the same rows, -1 if each row
    misses one of them, NULL where a column is always missing. Pairs are counted over masks.
    """
    df = present(df)
    masks, names, total = _masks(df, resolve_all(df, columns), 0)
    pairs = "flatten(transform(mask, a -> transform(filter(mask, b -> b >= a), b -> struct(a AS a, b AS b))))"
    counted = masks.selectExpr(f"explode({pairs}) AS p", "cnt").groupBy("p.a", "p.b").agg(F.sum("cnt").alias("n"))
    # One row per pair of columns, as for correlations.
    single = counted.filter("a = b")
    later = single.selectExpr("a", "n AS n_a", f"explode(sequence(0, {max(0, len(names) - 1)})) AS b").filter("a < b")
    grid = later.join(single.selectExpr("b", "n AS n_b"), "b")
    both = counted.filter("a < b").withColumnRenamed("n", "n_both")
    spread = f"sqrt(CAST(n_a AS DOUBLE) * ({total} - n_a) * n_b * ({total} - n_b))"
    listed = ", ".join(map(sql_text, names)) or "''"
    return grid.join(both, ["a", "b"], "left").selectExpr(
        f"array({listed})[a] AS col_a", f"array({listed})[b] AS col_b", "n_a", "n_b", "coalesce(n_both, 0L) AS n_both",
        f"try_divide(CAST({total} AS DOUBLE) * coalesce(n_both, 0L) - CAST(n_a AS DOUBLE) * n_b, {spread}) AS phi",
    )
