"""How often every value of every column occurs, as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.columns import family, quoted

DIGEST_CHARS = 64  # length of a SHA-256 digest in hex


def text_key(text: str) -> str:
    """A short text stays as it is, a long one is replaced by its SHA-256 digest.

    Only texts shorter than a digest stay, so the two cannot be confused. Rows that
    carry long texts are then shuffled at a fixed width.
    """
    return f"IF(length({text}) >= {DIGEST_CHARS}, sha2({text}, 256), {text})"


def row_key(field: T.StructField) -> str:
    """SQL for a value that is equal for two rows exactly when the column is."""
    name = quoted(field.name)
    kind = family(field.dataType)
    if kind == "text":
        return text_key(name)
    if isinstance(field.dataType, T.BinaryType):
        return f"sha2({name}, 256)"
    if kind == "other":
        value = f"array_sort(map_entries({name}))" if isinstance(field.dataType, T.MapType) else name
        options = "map('timestampFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")"
        return f"IF({name} IS NULL, NULL, sha2(to_json(struct({value} AS v), {options}), 256))"
    return name


def countable(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns whose values can be counted: all but nested and binary ones."""
    return [c for c in columns if family(df.schema[c].dataType) != "other"]


def _parts(field: T.StructField) -> tuple[str, str, str]:
    whole, num, txt = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"
    name, kind = quoted(field.name), family(field.dataType)
    if kind == "integral":
        whole = f"CAST({name} AS BIGINT)"
    elif kind == "fractional":
        num = f"CAST({name} AS DOUBLE)"
    elif kind == "decimal":
        num, txt = f"CAST({name} AS DOUBLE)", f"CAST({name} AS STRING)"
    elif kind == "text":
        txt = text_key(name)
    else:
        txt = f"CAST({name} AS STRING)"
    return whole, num, txt


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (column, value): ``cid, whole, num, txt, cnt``.

    ``cid`` is the place in ``columns``. Integers are kept in ``whole`` so that large
    ones stay exact, other numbers in ``num``, everything else in ``txt``; a missing
    value has all three NULL. Counts are combined before the shuffle, so a value that
    fills a third of the rows costs one row per task.
    """
    cells = [
        ", ".join([str(i), *_parts(df.schema[column])]) for i, column in enumerate(columns)
    ]
    if not cells:
        return df.sparkSession.createDataFrame(
            [], "cid int, whole bigint, num double, txt string, cnt bigint"
        )
    long = df.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (cid, whole, num, txt)")
    return long.groupBy("cid", "whole", "num", "txt").agg(F.count(F.lit(1)).alias("cnt"))


# SQL over the columns of value_frequencies.
NUMERIC_VALUE = "coalesce(num, CAST(whole AS DOUBLE))"
PRESENT = "(whole IS NOT NULL OR num IS NOT NULL OR txt IS NOT NULL)"
