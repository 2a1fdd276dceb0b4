"""Rules that say in which subgroups flagged rows are frequent."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.columns import families, number, present, require_numeric, resolve_all, sql_text
from plumbline.operators.outliers import column_limits
from plumbline.plans.groups import beside
from plumbline.plans.levels import column_levels
from plumbline.session import stage

COUNTS = "count(*) AS n", "count_if(flagged) AS n_flagged"


def flag_rules(
    df: DataFrame, flag: str, columns: list[str] | None = None, depth: int = 2,
    least_share: float = 0.05, least_lift: float = 1.5, bins: int = 8, exact: bool = False,
) -> DataFrame:
    """``rule, size, n, n_flagged, share, coverage, lift``: where the rows that ``flag`` names are frequent.

    ``flag`` is a SQL condition; a NULL is not flagged. A rule is a conjunction of at most
    ``depth`` levels of different ``columns`` (numbers are cut at ``bins`` quantiles, a missing
    value is a level). A rule covers at least ``least_share`` of the flagged rows, its share of
    flagged rows is at least ``least_lift`` times that of all rows, and larger than that of
    every rule with one level less: what adds nothing is not told. Without flagged rows
    there is no rule.

    A level-wise search, one scan of the rows a level. Only rules with enough flagged rows
    are extended, because no extension can have more; rules whose rows are all flagged are
    not, because none can be better. So single levels are at most columns / ``least_share``, and
    they alone reach the driver.
    """
    if depth < 1 or not 0 < least_share <= 1:
        raise ValueError("depth must be 1 or more and least_share in (0, 1]")
    df = present(df)
    kinds = families(df)
    columns = [c for c in resolve_all(df, columns) if kinds[c] != "other"]
    levels = column_levels(df, columns, bins, exact)
    listed = ", ".join(levels.texts[c] for c in columns)
    rows = df.selectExpr(f"coalesce({flag}, false) AS flagged", f"array({listed}) AS levels")
    total = rows.selectExpr(*COUNTS).first()
    least = max(1, math.ceil(least_share * total["n_flagged"]))
    single = (
        rows.selectExpr("flagged", "posexplode(levels) AS (cid, level)")
        .groupBy("cid", "level").agg(*map(F.expr, COUNTS))
        .filter(F.col("n_flagged") >= least)
    )
    items = sorted(single.collect(), key=lambda r: (r["cid"], r["level"] is not None, r["level"]))
    spark = df.sparkSession
    schema = "set array<int>, n long, n_flagged long"
    found = [spark.createDataFrame([([i], r["n"], r["n_flagged"]) for i, r in enumerate(items)], schema)]
    if items and total["n_flagged"]:
        numbered = rows.select("flagged", F.expr(_items_sql(items, len(columns))).alias("items"))
        for _ in range(1, min(depth, len(columns))):
            found.append(stage(_extended(numbered, found, least)))
    best = _improving(found).withColumns(
        {"share": F.col("n_flagged") / F.col("n"), "coverage": F.col("n_flagged") / F.lit(float(total["n_flagged"] or 1))}
    )
    base = (total["n_flagged"] or 0) / (total["n"] or 1)
    names = [levels.described(columns[r["cid"]], r["level"]) for r in items] or [""]
    said = f"array_join(transform(set, i -> array({', '.join(map(sql_text, names))})[i]), ' and ')"
    return best.withColumn("lift", F.col("share") / F.lit(base) if base else F.lit(None).cast("double")).filter(
        F.col("lift") >= least_lift
    ).selectExpr(f"{said} AS rule", "size(set) AS size", "n", "n_flagged", "share", "coverage", "lift")


def _items_sql(items: list, width: int) -> str:
    """SQL for the ascending numbers of a row's frequent levels."""
    by_column: dict[int, list[tuple[str, int]]] = {}
    for i, r in enumerate(items):
        level = "NULL" if r["level"] is None else sql_text(r["level"])
        by_column.setdefault(r["cid"], []).append((level, i))
    cells = []
    for cid, known in sorted(by_column.items()):
        plain = [(level, i) for level, i in known if level != "NULL"]
        missing = next((str(i) for level, i in known if level == "NULL"), "NULL")
        mapped = f"map({', '.join(f'{level}, {i}' for level, i in plain)})[levels[{cid}]]" if plain else "NULL"
        cells.append(f"IF(levels[{cid}] IS NULL, {missing}, {mapped})")
    return f"array_compact(array({', '.join(cells)}))" if width else "array()"


def _extended(rows: DataFrame, found: list[DataFrame], least: int) -> DataFrame:
    """The rules of one level more, from rules that others can still improve."""
    after = "explode(transform(filter(items, i -> i > element_at(set, -1)), i -> array_append(set, i))) AS set"
    sets = rows.selectExpr("flagged", "items", "explode(transform(items, i -> array(i))) AS set")
    for level in found:
        open_ = level.filter("n_flagged < n").select("set", "n")
        sets = beside(sets, ["set"], open_).selectExpr("flagged", "items", after)
    return sets.groupBy("set").agg(*map(F.expr, COUNTS)).filter(F.col("n_flagged") >= least)


def _improving(found: list[DataFrame]) -> DataFrame:
    """Rules whose share is larger than that of every rule with one level less."""
    best = found[0]
    for shorter, longer in zip(found, found[1:], strict=False):
        part = longer.selectExpr("set", "n", "n_flagged", "explode(set) AS left_out").selectExpr(
            "set", "n", "n_flagged", "array_remove(set, left_out) AS sub"
        )
        known = shorter.selectExpr("set AS sub", "n_flagged / n AS known")
        kept = part.join(known, "sub").groupBy("set", "n", "n_flagged").agg(F.max("known").alias("known"))
        best = best.unionByName(kept.filter("n_flagged / n > known").drop("known"))
    return best


def outlier_rules(
    df: DataFrame, column: str, columns: list[str] | None = None, method: str = "both", **options
) -> DataFrame:
    """:func:`flag_rules` for the outliers of a numeric column, over the other columns."""
    column = require_numeric(df, column)
    outlier = column_limits(df, [column], method)[column].flag(number(column))
    others = [c for c in resolve_all(df, columns) if c != column]
    return flag_rules(df, outlier, others, **options)

