"""The formats that the values of text columns have, and the values that have none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.columns import TEXT, quoted, resolve, resolve_all, sql_text
from plumbline.plans.groups import beside
from plumbline.session import stage

LONGEST = 64  # characters; a longer text is free text
FREE = "*"
SYMBOL_BITS = 8.0  # what a character of a pattern costs
VALUES_WEIGHED = 20  # average values that are described beside the patterns, however many there are

# The shapes of dates and times that have a name.
NAMED = {
    "9999-99-99": "yyyy-MM-dd",
    "9999/99/99": "yyyy/MM/dd",
    "9999-99-99 99:99:99": "yyyy-MM-dd HH:mm:ss",
    "9999-99-99A99:99:99": "yyyy-MM-ddTHH:mm:ss",
    "9999-99-99A99:99:99A": "yyyy-MM-ddTHH:mm:ssZ",
    "99:99": "HH:mm",
    "99:99:99": "HH:mm:ss",
}
SEPARATORS = "/.-"  # of dates whose day and month only their values tell apart


def shape_sql(text: str) -> str:
    """SQL for a text with digits as 9, capitals as A and small letters as a."""
    shape = f"regexp_replace(regexp_replace(regexp_replace({text}, '[0-9]', '9'), '\\\\p{{Lu}}', 'A'), '\\\\p{{Ll}}', 'a')"
    return f"IF(char_length({text}) > {LONGEST}, '{FREE}', {shape})"


def run_sql(shape: str) -> str:
    """SQL for a shape whose runs have any length: ``9+``, ``A+`` and ``a+``."""
    return f"regexp_replace({shape}, '(9|A|a)\\\\1*', '$1+')"


def _name_sql() -> str:
    """SQL for the name of a pattern; ``first`` and ``second`` are the largest parts of a date."""
    cases = [f"WHEN pattern = {sql_text(shape)} THEN {sql_text(name)}" for shape, name in NAMED.items()]
    for s in SEPARATORS:
        day, month = f"dd{s}MM{s}yyyy", f"MM{s}dd{s}yyyy"
        cases.append(
            f"WHEN pattern = '99{s}99{s}9999' THEN CASE WHEN first > '12' AND second > '12' THEN NULL"
            f" WHEN first > '12' THEN '{day}' WHEN second > '12' THEN '{month}' ELSE '{day} or {month}' END"
        )
    cases.append("WHEN pattern RLIKE '^[-+]?9+[+]?$' THEN 'whole number'")
    cases.append("WHEN pattern RLIKE '^[-+]?9{1,3}(,999)+([.]9+)?$' THEN 'thousands comma'")
    cases.append("WHEN pattern RLIKE '^[-+]?(9+[+]?)?[.]9+[+]?$' THEN 'decimal point'")
    cases.append("WHEN pattern RLIKE '^[-+]?(9+[+]?)?,9+[+]?$' THEN 'decimal comma'")
    return f"CASE {' '.join(cases)} END"


def _shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``cid, shape, run, n, example, first, second, spread`` of every shape that occurs."""
    cells = ", ".join(f"{i}, {quoted(c)}" for i, c in enumerate(columns))
    texts = df.selectExpr(f"stack({len(columns)}, {cells}) AS (cid, txt)").filter("txt IS NOT NULL")
    shapes = texts.selectExpr("cid", f"{shape_sql('txt')} AS shape", f"substring(txt, 1, {LONGEST}) AS txt")
    counted = shapes.groupBy("cid", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.min("txt").alias("example"),
        F.max(F.substring("txt", 1, 2)).alias("first"), F.max(F.substring("txt", 4, 2)).alias("second"),
    )
    # What a value costs beyond its letters if the runs may have any length: twice the bits of each length.
    runs = "aggregate(regexp_extract_all(shape, '(9+|A+|a+)', 1), 0D, (bits, r) -> bits + 2 * log2(char_length(r)) + 1)"
    return counted.selectExpr("*", f"{run_sql('shape')} AS run", f"n * {runs} AS spread")


def _chosen(shapes: DataFrame) -> DataFrame:
    """``shapes`` with ``pattern``: the shape itself, or its runs where that describes the values in fewer bits."""
    told = stage(shapes)
    runs = told.groupBy("cid", "run").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows"), F.sum("spread").alias("spread"),
        F.sum(F.char_length("shape") * SYMBOL_BITS).alias("symbols"), F.sum(F.col("n") * F.log2("n")).alias("own"),
    )
    apart = f"symbols + {VALUES_WEIGHED} * (log2(rows) - own / rows)"
    together = f"char_length(run) * {SYMBOL_BITS}D + {VALUES_WEIGHED} * spread / rows"
    runs = stage(runs.selectExpr("cid", "run", "n", f"{apart} <= {together} AS apart"))
    met = beside(told.withColumnRenamed("n", "found"), ["cid", "run"], runs)
    return met.selectExpr("cid", "IF(apart, shape, run) AS pattern", "shape", "found AS n", "example", "first", "second")


def text_formats(df: DataFrame, columns: list[str] | None = None, least_share: float = 0.05) -> DataFrame:
    """``column, pattern, format, n, share, example, is_off`` of the text columns.

    A pattern is what a value's characters are (digit 9, capital A, small letter a, others
    themselves), with or without the lengths of their runs: ``99/99/9999``, ``A+-9+``. Shapes
    with the same runs are told as one pattern if that describes the patterns and twenty
    average values in fewer bits: shapes apart cost their characters and each value the choice
    among them; one pattern costs its characters once and each value the lengths of its
    runs. So fixed widths stay, and numbers of any length are one. ``format`` names dates, times and
    numbers; whether a date begins with the day its largest values tell. Patterns of less
    than ``least_share`` of a column's values are off: mistyped values, or free text. Texts of
    more than 64 characters are one pattern, ``*``. Missing values are left out. ``example`` is the
    least value. Shapes are counted in one scan, combined in the task.
    """
    if not 0 <= least_share <= 1:
        raise ValueError("least_share must lie in [0, 1]")
    columns = [c for c in resolve_all(df, columns) if isinstance(df.schema[c].dataType, TEXT)]
    if not columns:
        raise ValueError("there is no text column")
    patterns = _chosen(_shapes(df, columns)).groupBy("cid", "pattern").agg(
        F.sum("n").alias("n"), F.min("example").alias("example"), F.max("first").alias("first"), F.max("second").alias("second")
    )
    totals = patterns.groupBy("cid").agg(F.sum("n").alias("total"))
    names = ", ".join(map(sql_text, columns))
    # One row per column on the broadcast side.
    return patterns.join(F.broadcast(totals), "cid").selectExpr(
        f"array({names})[cid] AS column", "pattern", f"{_name_sql()} AS format", "n", "n / total AS share", "example",
        f"n < {float(least_share)!r}D * total AS is_off",
    )


def off_format_values(df: DataFrame, column: str, least_share: float = 0.05) -> DataFrame:
    """``value, pattern, count`` of the values of a text column whose pattern is off."""
    column = resolve(df, column)
    off = text_formats(df, [column], least_share).filter("is_off").select("pattern")
    shapes = _chosen(_shapes(df, [column])).join(off, "pattern").select("shape", "pattern", "n")
    values = df.selectExpr(f"{quoted(column)} AS value").filter("value IS NOT NULL")
    values = values.selectExpr("value", f"{shape_sql('value')} AS shape")
    return (
        beside(values, ["shape"], stage(shapes)).drop("n")
        .groupBy("value", "pattern").agg(F.count(F.lit(1)).alias("count"))
    )
