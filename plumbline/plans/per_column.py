"""Tables with one row per column of the profiled frame.

Measures are SQL texts: a frame of many columns needs many small expressions, and one
parsed text is built much faster than a tree of calls.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from plumbline.columns import sql_text


def wide_to_long(df: DataFrame, columns: list[str], measures: dict[str, list[str]]) -> DataFrame:
    """Aggregate ``df`` once and turn the single wide row into one row per column.

    ``measures[m][i]`` is the aggregate that becomes measure ``m`` of ``columns[i]``.
    The result has ``cid, column`` and the measures.
    """
    names = list(measures)
    if not columns:
        # Zero rows; the types of the measures are not known without a column.
        fields = ", ".join(f"{m} double" for m in names)
        return df.sparkSession.createDataFrame([], f"cid int, column string, {fields}")
    wide = df.selectExpr(
        *[f"{measures[m][i]} AS m{j}_{i}" for i in range(len(columns)) for j, m in enumerate(names)]
    )
    cells = [
        ", ".join([str(i), sql_text(column), *[f"m{j}_{i}" for j in range(len(names))]])
        for i, column in enumerate(columns)
    ]
    return wide.selectExpr(
        f"stack({len(columns)}, {', '.join(cells)}) AS (cid, column, {', '.join(names)})"
    )


def pin(df: DataFrame) -> DataFrame:
    """Compute a table with one row per column now, and keep the rows as they came out.

    Only for tables whose row count the schema bounds: later steps then read the
    rows instead of scanning the data again.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def together(*jobs: Callable) -> list:
    """What independent jobs give, run at the same time."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [future.result() for future in [pool.submit(job) for job in jobs]]
