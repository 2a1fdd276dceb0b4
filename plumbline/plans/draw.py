"""Samples of an exact size, drawn by a hash, without ordering or gathering a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import thresholds as t
from plumbline.plans.groups import beside
from plumbline.session import stage


def exactly(df: DataFrame, group: Column, wanted: Column, draw: Column, tie: Column) -> DataFrame:
    """Of each group the ``wanted`` rows (all, if it has fewer) whose ``draw`` is smallest, ties by ``tie``.

    ``group`` is a text without nulls, ``wanted`` a number that is equal over a group, ``draw`` an even
    random number in [0, 1) that the row's values decide. Counts of the groups say where
    the threshold must lie, up to a margin of about the root of ``wanted`` rows. Rows below the margin
    are taken where they are; those within it, few, are counted by draw, and only rows of the
    draw that crosses the threshold are numbered, by the parts they were written in. If
    a margin misses its threshold, which chance makes about never, it is widened.
    Rows that are equal in draw and tie are taken in any order.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    longest = max(map(len, df.columns), default=0)
    key, want, u, v, n, low, high, size = (f"x{i}_".ljust(longest + 4, "_") for i in range(8))
    rows = df.select(*names, group.alias(key), wanted.cast("long").alias(want), draw.alias(u), tie.alias(v))
    rows = rows.filter(F.col(want) > 0)
    sizes = rows.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.max(want).alias("want"))
    share = F.col("want") / F.col("n")
    reach = t.DRAW_MARGIN * (F.sqrt(share * F.greatest(F.lit(0.0), 1 - share) / F.col("n")) + 1 / F.col("n"))
    marks = stage(sizes.select(key, "n", "want", (share - reach).alias("low"), (share + reach).alias("high")))
    while True:
        ends = marks.select(key, F.col("n").alias(size), F.col("low").alias(low), F.col("high").alias(high))
        met = beside(rows, [key], ends, size)
        counts = met.groupBy(key).agg(
            F.count_if(F.col(u) < F.col(low)).alias("below"),
            F.count_if(F.col(u).between(F.col(low), F.col(high))).alias("within"),
        )
        counts = stage(marks.join(counts, key))
        missed = (F.col("want") < F.col("n")) & (
            (F.col("below") > F.col("want")) | (F.col("below") + F.col("within") < F.col("want"))
        )
        if counts.filter(missed).isEmpty():
            break
        wide = F.when(missed, 4.0).otherwise(1.0) * (F.col("high") - F.col("low")) / 2
        middle = (F.col("high") + F.col("low")) / 2
        marks = stage(counts.select(key, "n", "want", (middle - wide).alias("low"), (middle + wide).alias("high")))
    whole = F.col("want") >= F.col("n")
    ends = counts.select(
        key, F.col("n").alias(size), F.when(whole, 2.0).otherwise(F.col("low")).alias(low),
        F.when(whole, 2.0).otherwise(F.col("high")).alias(high), (F.col("want") - F.col("below")).alias(n),
    )
    ends = stage(ends)
    met = beside(rows, [key], ends, size)
    taken = met.filter(F.col(u) < F.col(low)).select(*names)
    within = stage(
        met.filter(F.col(u).between(F.col(low), F.col(high))).select(*names, key, u, v, n, F.spark_partition_id().alias(low))
    )
    # Which rows of the margin: whole (draw, tie, part) groups, and of the one that crosses the rest.
    held = within.groupBy(key, u, v, low, n).agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy(key).orderBy(u, v, low).rowsBetween(Window.unboundedPreceding, -1)
    open_ = (
        held.withColumn(size, F.col(n) - F.coalesce(F.sum("held").over(before), F.lit(0)))
        .filter(F.col(size) > 0)
        .select(key, u, v, low, size)
    )
    place = F.row_number().over(Window.partitionBy(key, u, v, low).orderBy(F.lit(0)))
    chosen = within.withColumn(high, place).join(open_, [key, u, v, low]).filter(F.col(high) <= F.col(size))
    return taken.unionByName(chosen.select(*names))
