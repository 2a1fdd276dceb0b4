"""Rows next to a table with one row per group, however many rows a group has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import thresholds as t

KEY_BYTES = 2048  # longer keys stay out of what is broadcast


def beside(rows: DataFrame, by: list[str], groups: DataFrame, n: str = "n") -> DataFrame:
    """``rows`` joined with ``groups`` on ``by``; keys are not null.

    ``groups`` has one row per group, of few fields beside its keys, and its rows in column ``n``.
    Give a written table: it is read more than once. Groups with more than one part in
    ``GROUPS_AT_HAND`` of all rows are fewer than that, so they are broadcast, and their
    rows stay where they are. All other groups are small and meet their rows in a shuffle,
    in which none can make a task large. If there are few groups altogether, all are
    broadcast, and nothing is shuffled. Keys of more than ``KEY_BYTES`` bytes are never broadcast,
    so what is broadcast has a fixed bound.
    """
    width = reduce(lambda a, b: a + b, [F.octet_length(F.col(k).cast("string")) for k in by])
    short = width <= KEY_BYTES
    facts = groups.agg(
        F.count(F.lit(1)).alias("groups"), F.sum(n).alias("rows"), F.count_if(~short).alias("long")
    ).first()
    few = facts["groups"] <= t.GROUPS_AT_HAND
    at_hand = short if few else short & (F.col(n) > (facts["rows"] or 0) / t.GROUPS_AT_HAND)
    large = F.broadcast(groups.filter(at_hand))
    met = rows.join(large, by)
    if few and not facts["long"]:
        return met
    others = rows.join(F.broadcast(groups.filter(at_hand).select(*by)), by, "left_anti")
    return met.unionByName(others.join(groups.filter(~at_hand), by))
