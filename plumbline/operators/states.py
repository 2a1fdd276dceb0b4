"""Profiles of data that comes in parts: states of each part are kept, and merged without reading the parts again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import thresholds as t
from plumbline.columns import families, number, present, quoted, resolve_all
from plumbline.plans.per_column import wide_to_long

DISTINCT_BITS = 14  # log2 of the registers of a distinct count, which is off by about one percent
STATE = (
    "column string, family string, n_rows bigint, n_missing bigint, n bigint, mean double, m2 double,"
    " min double, max double, ranks binary, distinct binary"
)
NUMERIC = ("integral", "fractional", "decimal")


def profile_state(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: counts, moments, range, a sketch of the ranks and one of the distinct values.

    One scan, one wide aggregate. A state has a bounded size whatever the number of rows. Columns
    that are not numbers have no moments, range and ranks; nested ones are left out.
    """
    df = present(df)
    kinds = families(df)
    columns = [c for c in resolve_all(df, columns) if kinds[c] != "other"]
    if not columns:
        raise ValueError("there is no column whose values can be counted")
    numeric = [kinds[c] in NUMERIC for c in columns]
    values = [number(c) for c in columns]

    def measured(text: str, kind: str) -> list[str]:
        none = f"max(CAST(NULL AS {kind}))"
        return [text.format(v) if is_number else none for v, is_number in zip(values, numeric, strict=True)]

    long = wide_to_long(
        df, columns,
        {
            "family": [f"max('{kinds[c]}')" for c in columns],
            "n_rows": ["count(*)"] * len(columns),
            "n_missing": [f"count_if({quoted(c)} IS NULL)" for c in columns],
            "n": measured("count({0})", "BIGINT"),
            "mean": measured("avg({0})", "DOUBLE"),
            "m2": measured("var_pop({0}) * count({0})", "DOUBLE"),
            "min": measured("min({0})", "DOUBLE"),
            "max": measured("max({0})", "DOUBLE"),
            "ranks": measured(f"kll_sketch_agg_double({{0}}, {t.SKETCH_SIZE})", "BINARY"),
            "distinct": [f"hll_sketch_agg(CAST({quoted(c)} AS STRING), {DISTINCT_BITS})" for c in columns],
        },
    )
    return long.drop("cid")


def merged_report(states: DataFrame) -> DataFrame:
    """``column, family, n_rows, n_missing, missing_pct, n_unique, mean, std, min, q1, median, q3, max`` of all parts.

    ``states`` holds the rows of :func:`profile_state` of any number of parts. Counts, range, mean and
    deviation are those of the parts together; ``n_unique`` and the quartiles are approximate, as
    sketches of the whole would be. A column that some parts lack counts the rows of the others.
    States of one column with different families have family ``mixed``. One group per column.
    """
    total = states.groupBy("column").agg(
        F.expr("IF(min(family) = max(family), min(family), 'mixed') AS family"),
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), F.sum("n").alias("total"),
        F.expr("try_divide(sum(n * mean), sum(n)) AS all_mean"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.expr("kll_merge_agg_double(ranks) AS ranks"),
        F.expr("hll_sketch_estimate(hll_union_agg(distinct, true)) AS n_unique"),
    )
    # Deviations of the parts' means from the mean of all; one row per column is joined to one per column and part.
    centres = total.select("column", "all_mean")
    spread = (
        states.join(centres, "column")
        .groupBy("column")
        .agg(F.expr("sum(m2 + n * (mean - all_mean) * (mean - all_mean)) AS m2"))
    )
    quartiles = "IF(total > 0, kll_sketch_get_quantile_double(ranks, array(0.25D, 0.5D, 0.75D)), NULL) AS q"
    return total.join(spread, "column").selectExpr("*", quartiles).selectExpr(
        "column", "family", "n_rows", "n_missing", "n_missing / greatest(1, n_rows) AS missing_pct", "n_unique",
        "all_mean AS mean", "sqrt(try_divide(m2, total - 1)) AS std", "min", "q[0] AS q1", "q[1] AS median", "q[2] AS q3", "max",
    )


class ProfileStates:
    """States by part, in an append-only table in a folder that all executors share.

    A part that is added again replaces its former state, so a batch that a stream delivers
    twice counts once: ``query.foreachBatch(lambda df, i: states.add(df, f"batch {i}"))``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, df: DataFrame, part: str) -> None:
        """Profile a part, in one scan, and append its state."""
        state = profile_state(df).withColumns({"part": F.lit(part), "added_at": F.current_timestamp()})
        state.coalesce(1).write.mode("append").parquet(self.folder)

    def states(self) -> DataFrame:
        """The newest state of each part."""
        schema = f"{STATE}, part string, added_at timestamp"
        every = self.spark.read.schema(schema).parquet(self.folder)
        newest = every.groupBy("part").agg(F.max("added_at").alias("added_at"))
        return every.join(newest, ["part", "added_at"]).select("part", *[f.split()[0] for f in STATE.split(", ")])

    def report(self, parts: list[str] | None = None) -> DataFrame:
        """The profile of all parts together, or of the named ones."""
        states = self.states()
        return merged_report(states if parts is None else states.filter(F.col("part").isin(parts)))
