"""Shards from a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import whole_text
from plumbline.session import stage

ARC_BITS = 14  # the ring has 2 ** ARC_BITS arcs; their counts are all that reaches the driver
VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, arcs: int = 1 << ARC_BITS) -> list[tuple[int, int]]:
    """The virtual nodes as (arc, shard), clockwise. A shard's nodes depend on its number alone."""
    nodes = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            place = hashlib.md5(f"{shard}/{node}".encode()).hexdigest()
            nodes.append((int(place[:15], 16) % arcs, shard))
    return sorted(nodes)


def capacities(total: int, shards: int, balance: float = 1.0) -> list[int]:
    """Most rows of each shard; with ``balance`` 1 they add up to ``total`` and differ by one at most."""
    even, rest = divmod(total, shards)
    exact = [even + (shard < rest) for shard in range(shards)]
    return exact if balance <= 1 else [max(c, int(balance * total / shards)) for c in exact]


def allot(counts: dict[int, int], nodes: list[tuple[int, int]], rooms: list[int]) -> list[tuple]:
    """Where the rows of each arc go: (arc, first rank, end rank, shard, slot of the first).

    Arcs are served clockwise. An arc's rows go to the next virtual node; what its shard
    has no room for continues clockwise to the next node whose shard has.
    """
    rooms, used = list(rooms), [0] * len(rooms)
    following = [(i + 1) % len(nodes) for i in range(len(nodes))]
    placed, at = [], 0

    def open_node(i: int) -> int:
        """The first node at or after ``i`` whose shard has room; full ones are skipped for good."""
        passed = []
        while not rooms[nodes[i][1]]:
            passed.append(i)
            i = following[i]
        for p in passed:
            following[p] = i
        return i

    for arc in sorted(counts):
        while at < len(nodes) and nodes[at][0] < arc:
            at += 1
        rank, left, node = 0, counts[arc], at % len(nodes)
        while left:
            node = open_node(node)
            shard = nodes[node][1]
            take = min(left, rooms[shard])
            placed.append((arc, rank, rank + take, shard, used[shard]))
            rooms[shard] -= take
            used[shard] += take
            rank, left = rank + take, left - take
    return placed


def shard_rows(docs: DataFrame, shards: int = 16, balance: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1. A row's place on the ring is
    a hash of its doc_id, or of its text where the doc_id is null. With ``balance`` 1
    (the default) the shards' row counts differ by one at most; a larger value lets a
    shard hold that many times the mean and moves fewer rows when shards are added.
    ``slot`` numbers the rows of a shard from 0 without gaps. Repeated rows are rows of
    their own. Other columns are not read. No rows give no rows.

    The driver sees one count per arc. Rows are ranked inside their arc only.
    """
    text = whole_text()
    keys = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    spot = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    keys = stage(
        keys.withColumn("spot", spot).withColumn("arc", F.shiftrightunsigned("spot", 64 - ARC_BITS).cast("int"))
    )
    counts = {r["arc"]: r["n"] for r in keys.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = allot(counts, ring(shards), capacities(sum(counts.values()), shards, balance))
    # One row per arc, and one more each time a shard fills up inside an arc.
    plan = keys.sparkSession.createDataFrame(
        placed, "arc int, first long, end long, shard int, slot_start long"
    )
    inside = Window.partitionBy("arc").orderBy("spot", "doc_id", "size", "text_crc32")
    ranked = keys.withColumn("rank", (F.row_number().over(inside) - 1).cast("long"))
    return ranked.join(
        F.broadcast(plan),
        (ranked["arc"] == plan["arc"]) & (ranked["rank"] >= plan["first"]) & (ranked["rank"] < plan["end"]),
    ).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot_start") + F.col("rank") - F.col("first")).alias("slot")
    )
