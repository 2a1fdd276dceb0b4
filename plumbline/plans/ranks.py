"""Exact quantiles and order statistics, by one plan at every size.

A first scan makes sketches, merged in two levels. They give a bracket of values around
each wanted rank. A second scan counts what lies below the brackets, and only the
values inside them, about a hundredth, are grouped and ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import thresholds as t
from plumbline.columns import quoted, sql_double
from plumbline.plans.groups import beside
from plumbline.plans.per_column import wide_to_long
from plumbline.session import stage


def bucket_sql(bounds: list[float], value: str) -> str:
    """SQL for the number of ``bounds`` (ascending) that are at most ``value``, in two steps."""
    literal = lambda b: f"{float(b)!r}D" if math.isfinite(b) else sql_double(b)
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    listed = [f"CAST(array({', '.join(map(literal, part))}) AS array<double>)" for part in parts]
    tops = f"CAST(array({', '.join(literal(part[0]) for part in parts[1:])}) AS array<double>)"
    part = f"size(filter({tops}, b -> b <= {value}))"
    return f"({part} * {step} + size(filter(array({', '.join(listed)})[{part}], b -> b <= {value})))"


def sketched(df: DataFrame, cells: list[str], shares: list[list[float]]) -> list[tuple[int, list]]:
    """Per cell the number of values and the sketched values at its ``shares`` (each cell has as many).

    Cells are SQL doubles. Sketches of groups of tasks are merged before those of all, so
    no task merges the sketches of every task. One row per cell reaches the driver.
    """
    if not cells:
        return []
    names = [str(i) for i in range(len(cells))]
    each = [F.expr(f"kll_sketch_agg_double({c}, {t.SKETCH_SIZE}) AS k{i}") for i, c in enumerate(cells)]
    group = F.expr(f"spark_partition_id() % {t.SKETCH_GROUPS}").alias("part")
    grouped = df.groupBy(group).agg(*each)
    merged = [f"kll_merge_agg_double(k{i})" for i in range(len(cells))]
    found = []
    for i, share in enumerate(shares):
        wanted = ", ".join(sql_double(s) for s in share)
        sketch = merged[i]
        found.append(
            f"IF(kll_sketch_get_n_double({sketch}) > 0,"
            f" kll_sketch_get_quantile_double({sketch}, array({wanted})), NULL)"
        )
    counts = [f"kll_sketch_get_n_double({sketch})" for sketch in merged]
    rows = wide_to_long(grouped, names, {"n": counts, "q": found}).collect()
    by_name = {row["column"]: (row["n"] or 0, row["q"]) for row in rows}
    return [by_name[name] for name in names]


def _ends(p: float) -> tuple[float, float]:
    return max(0.0, p - t.RANK_MARGIN), min(1.0, p + t.RANK_MARGIN)


def column_quantiles(df: DataFrame, cells: list[str], probs: list[float]) -> DataFrame:
    """``cid, q``: the linearly interpolated quantiles of each cell, in the order of ``probs``.

    ``cells`` are SQL doubles, NULL where missing; ``cid`` is the place among them. A cell
    without values gives no row. While a bracket holds more than ``BRACKET_VALUES``
    values, it is narrowed by another sketch of the values inside it.
    """
    shares = [0.0, 1.0, *[end for p in probs for end in _ends(p)]]
    wanted = []  # cid, place of the probability, rank, share of the next, bracket
    for cid, (n, q) in enumerate(sketched(df, cells, [shares] * len(cells))):
        for j, p in enumerate(probs if n else []):
            place = (n - 1) * p
            few = n * t.RANK_MARGIN < 4
            low, high = (q[0], q[1]) if few else (q[2 + 2 * j], q[3 + 2 * j])
            wanted.append([cid, j, math.floor(place), place - math.floor(place), low, high])
    empty = df.sparkSession.createDataFrame([], "cid int, q array<double>")
    if not wanted:
        return empty
    while True:
        inside = [f"{cells[w[0]]} >= {sql_double(w[4])} AND {cells[w[0]]} <= {sql_double(w[5])}" for w in wanted]
        row = df.selectExpr(
            *[f"count_if({cells[w[0]]} < {sql_double(w[4])}) AS b{i}" for i, w in enumerate(wanted)],
            *[f"count_if({text}) AS i{i}" for i, text in enumerate(inside)],
        ).first()
        below = [row[f"b{i}"] for i in range(len(wanted))]
        held = [row[f"i{i}"] for i in range(len(wanted))]
        wide = [
            i for i, w in enumerate(wanted)
            if held[i] > t.BRACKET_VALUES and held[i] * t.RANK_MARGIN >= 4 and w[4] < w[5]
        ]
        if not wide:
            break
        cut = [f"IF({inside[i]}, {cells[wanted[i][0]]}, NULL)" for i in wide]
        at = [(wanted[i][2] - below[i]) / held[i] for i in wide]
        narrowed = sketched(df, cut, [list(_ends(p)) for p in at])
        before = [w[4:] for w in wanted]
        for i, (_, q) in zip(wide, narrowed, strict=True):
            wanted[i][4:] = q
        if before == [w[4:] for w in wanted]:
            break  # what is left are few heavy values
    brackets = df.sparkSession.createDataFrame(
        [(*w, b) for w, b in zip(wanted, below, strict=True)],
        "cid int, place int, rank long, share double, low double, high double, below long",
    )
    near: dict[int, list[str]] = {}
    for w, text in zip(wanted, inside, strict=True):
        near.setdefault(w[0], []).append(text)
    listed = ", ".join(f"{cid}, IF({' OR '.join(texts)}, {cells[cid]}, NULL)" for cid, texts in near.items())
    values = (
        df.selectExpr(f"stack({len(near)}, {listed}) AS (cid, value)")
        .filter("value IS NOT NULL")
        .groupBy("cid", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # One row per cell and probability.
    found = values.join(F.broadcast(brackets), "cid").filter("value BETWEEN low AND high")
    return _interpolated(found, ["cid"], len(probs))


def _interpolated(found: DataFrame, by: list[str], places: int) -> DataFrame:
    """``by, q`` from ``by, place, rank, share, below, value, cnt``: the values of each bracket."""
    order = Window.partitionBy(*by, "place").orderBy("value")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("upto", F.col("below") + F.sum("cnt").over(upto))
    at = lambda rank: f"max(IF(upto - cnt <= {rank} AND {rank} < upto, value, NULL))"
    found = found.groupBy(*by, "place").agg(
        F.expr(f"{at('rank')} AS low"), F.expr(f"{at('rank + 1')} AS high"), F.first("share").alias("share")
    )
    found = found.selectExpr(
        *by,
        "place",
        "CASE WHEN low IS NULL OR (share > 0 AND high IS NULL) THEN CAST(raise_error('rank outside its bracket') AS DOUBLE)"
        " WHEN share = 0 OR low = high THEN low ELSE low * (1 - share) + high * share END AS value",
    )
    wanted = [F.expr(f"max(IF(place = {j}, value, NULL))") for j in range(places)]
    return found.groupBy(*by).agg(F.array(*wanted).alias("q"))


def group_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles of ``value`` per group: ``by, q``. Rows with a missing value or key are left out.

    As :func:`column_quantiles`, with the brackets of each group next to its rows. A scan
    makes sketches per group, merged in two levels. While a group's bracket holds more than
    ``BRACKET_VALUES`` values, rows below it are counted and the values inside sketched again, by
    parts, for such groups alone. At the end the values of one bracket are ordered in one
    task: never more than that many, whatever the size of the group.
    """
    keyed = " AND ".join(f"{quoted(k)} IS NOT NULL" for k in by)
    rows = df.select(*by, F.col(value).alias("value")).filter(f"value IS NOT NULL AND {keyed}")
    shares = ", ".join(sql_double(s) for s in [0.0, 1.0, *[end for p in probs for end in _ends(p)]])
    marks = _group_sketches(rows, by, ["value"])
    marks = marks.selectExpr(
        *map(quoted, by), "kll_sketch_get_n_double(s0) AS n",
        f"kll_sketch_get_quantile_double(s0, array({shares})) AS ends",
    )
    few = f"n * {sql_double(t.RANK_MARGIN)} < 4"
    brackets = ", ".join(
        f"named_struct('place', {j}, 'rank', CAST(floor((n - 1) * {sql_double(p)}) AS BIGINT),"
        f" 'share', (n - 1) * {sql_double(p)} - floor((n - 1) * {sql_double(p)}),"
        f" 'low', IF({few}, ends[0], ends[{2 + 2 * j}]), 'high', IF({few}, ends[1], ends[{3 + 2 * j}]),"
        # Values that the bracket may hold, a half more than expected.
        f" 'held', IF({few}, n, CAST(ceil(n * {sql_double(3 * t.RANK_MARGIN)}) AS BIGINT)))"
        for j, p in enumerate(probs)
    )
    marks = stage(marks.selectExpr(*map(quoted, by), "n", f"array({brackets}) AS brackets"))
    marks = _narrowed(rows, by, marks, len(probs))
    touched = beside(rows, by, marks).select(
        *by, F.expr("explode(filter(brackets, b -> value <= b.high)) AS b"), "value"
    )
    counted = (
        touched.select(*by, "b.place", "b.rank", "b.share", F.expr("IF(value < b.low, NULL, value) AS value"))
        .groupBy(*by, "place", "rank", "share", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # Values below a bracket are one row, without a value, that comes first.
    return _interpolated(counted.withColumn("below", F.lit(0).cast("long")), by, len(probs))


def _group_sketches(rows: DataFrame, by: list[str], cells: list[str], more: list[str] | None = None) -> DataFrame:
    """``by, s0, s1 ...``: a sketch of each cell per group, merged in two levels; ``more`` are counts, summed."""
    part = F.expr(f"spark_partition_id() % {t.SKETCH_GROUPS}").alias("part")
    sketch = [F.expr(f"kll_sketch_agg_double({c}, {t.SKETCH_SIZE}) AS s{i}") for i, c in enumerate(cells)]
    counts = [F.expr(f"{text} AS n{i}") for i, text in enumerate(more or [])]
    merged = [F.expr(f"kll_merge_agg_double(s{i}) AS s{i}") for i in range(len(cells))]
    summed = [F.expr(f"sum(n{i}) AS n{i}") for i in range(len(counts))]
    return rows.groupBy(*by, part).agg(*sketch, *counts).groupBy(*by).agg(*merged, *summed)


def _narrowed(rows: DataFrame, by: list[str], marks: DataFrame, places: int) -> DataFrame:
    """``marks`` whose brackets hold at most ``BRACKET_VALUES`` values, or few heavy ones.

    Only groups that are too wide are read again, and there are few: each has many times that
    number of rows.
    """
    names = [quoted(k) for k in by]
    # Sketches are asked for an even grid of values, of which two are the ends of a bracket.
    steps = math.floor(1 / t.RANK_MARGIN)
    grid = ", ".join(sql_double(i / steps) for i in range(steps + 1))
    grids = [f"kll_sketch_get_quantile_double(s{j}, array({grid}))" for j in range(places)]
    wide = f"exists(brackets, b -> b.held > {t.BRACKET_VALUES} AND b.held * {sql_double(t.RANK_MARGIN)} >= 4 AND b.low < b.high)"
    while marks.filter(wide).limit(1).count():
        inside = [f"value >= brackets[{j}].low AND value <= brackets[{j}].high" for j in range(places)]
        cells = [f"IF({text}, value, NULL)" for text in inside]
        counts = [f"count_if(value < brackets[{j}].low)" for j in range(places)]
        counts += [f"count_if({text})" for text in inside]
        found = _group_sketches(beside(rows, by, marks.filter(wide)), by, cells, counts)
        again = []
        for j in range(places):
            b, below, held = f"brackets[{j}]", f"n{j}", f"n{places + j}"
            at = f"(({b}.rank - {below}) / {held} * {steps})"
            many = f"{held} > {t.BRACKET_VALUES} AND {held} * {sql_double(t.RANK_MARGIN)} >= 4"
            new = [
                f"g{j}[greatest(0, CAST(floor({at}) AS INT) - 1)]",
                f"g{j}[least({steps}, CAST(ceil({at}) AS INT) + 1)]",
            ]
            low, high = f"IF({many}, {new[0]}, {b}.low)", f"IF({many}, {new[1]}, {b}.high)"
            # A bracket that stays as it was holds few heavy values.
            kept = f"{low} = {b}.low AND {high} = {b}.high"
            count = f"CASE WHEN NOT ({many}) THEN {held} WHEN {kept} THEN 0L ELSE CAST(ceil({held} * 4.5D / {steps}) AS BIGINT) END"
            again.append(
                f"named_struct('place', {j}, 'rank', {b}.rank, 'share', {b}.share,"
                f" 'low', {low}, 'high', {high}, 'held', {count})"
            )
        found = found.selectExpr("*", *[f"{text} AS g{j}" for j, text in enumerate(grids)]).join(marks.filter(wide), by)
        found = found.selectExpr(*names, "n", f"array({', '.join(again)}) AS brackets")
        marks = stage(marks.filter(f"NOT {wide}").unionByName(found))
    return marks


def order_statistics(df: DataFrame, value: str, targets: DataFrame) -> DataFrame:
    """``rank, value``: the value at each wanted 0-based rank of a column without missing values.

    ``targets`` has ``rank``. Equal values are counted and dealt by ranges into buckets,
    one for every ``BRACKET_VALUES`` rows; their totals, one row each, say which bucket
    holds a rank. Only buckets that hold one are ordered, each by itself.
    """
    rows = df.selectExpr(f"{value} AS value")
    n_buckets = max(t.RANK_BUCKETS, math.ceil(rows.count() / t.BRACKET_VALUES))
    ranges = rows.groupBy("value").agg(F.count(F.lit(1)).alias("cnt")).repartitionByRange(n_buckets, "value")
    # Ranges come from a sample of the values; the written table keeps one choice of them.
    freq = stage(ranges.withColumn("bucket", F.spark_partition_id()))
    totals = freq.groupBy("bucket").agg(F.sum("cnt").alias("total")).collect()
    buckets, starts, start = [], [], 0
    for row in sorted(totals, key=lambda r: r["bucket"]):
        buckets.append(row["bucket"])
        starts.append(float(start))
        start += row["total"]
    place = F.expr(f"{bucket_sql(starts, 'CAST(rank AS DOUBLE)')} - 1")
    pick = lambda listed: F.element_at(F.array(*[F.lit(x) for x in listed]), F.col("place") + 1)
    marks = (
        targets.select("rank").distinct().filter(F.col("rank") < start).withColumn("place", place)
        .select("rank", pick(buckets).alias("bucket"), (F.col("rank") - pick([int(s) for s in starts])).alias("position"))
    ) if buckets else None
    if marks is None:
        return targets.sparkSession.createDataFrame([], "rank long, value double")
    upto = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = freq.join(marks.select("bucket").distinct(), "bucket", "left_semi")
    values = chosen.select(
        "bucket", (F.sum("cnt").over(upto) - 1).alias("position"), F.lit(1).alias("is_value"),
        F.lit(None).cast("long").alias("rank"), F.col("value").alias("known"),
    )
    wanted = marks.select(
        "bucket", "position", F.lit(0).alias("is_value"), "rank", F.lit(None).cast("double").alias("known")
    )
    # Read from the far end: the last value met at or beyond a position holds it.
    back = (
        Window.partitionBy("bucket")
        .orderBy(F.col("position").desc(), F.col("is_value").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        values.unionByName(wanted.select(*values.columns))
        .withColumn("value", F.last("known", ignorenulls=True).over(back))
        .filter("is_value = 0")
        .select("rank", "value")
    )
