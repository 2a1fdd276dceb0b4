"""Packing into length buckets whose boundaries waste the least padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import numbered, word_count
from plumbline.session import stage

BUCKETS = 8
BATCH_TOKENS = 32768
# Lengths up to 511 are cells of their own; beyond, a cell spans 1/256 of a power of two.
CELL = "shiftleft(shiftright(n_tokens, greatest(0, length(bin(n_tokens)) - 9)), greatest(0, length(bin(n_tokens)) - 9))"


def best_boundaries(tops: list[int], counts: list[int], tokens: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets over the cells that waste the fewest tokens.

    ``tops`` are the longest lengths of the cells, ascending. Dynamic programming: the
    least padding of the first j cells in k buckets is the best of all last buckets
    i..j added to the least padding of the first i cells in k - 1. Of equal costs, the
    smallest i wins, and fewer buckets win over more.
    """
    m = len(tops)
    if not m:
        return []
    top = np.array(tops, dtype=np.float64)
    held = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    filled = np.concatenate([[0], np.cumsum(tokens)]).astype(np.float64)
    least = np.full(m + 1, np.inf)
    least[0] = 0
    best, choices = np.inf, []
    cut, steps = [], []
    for _ in range(min(buckets, m)):
        now, origin = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            cost = least[:j] + top[j - 1] * (held[j] - held[:j]) - (filled[j] - filled[:j])
            origin[j] = int(np.argmin(cost))
            now[j] = cost[origin[j]]
        steps.append(origin)
        least = now
        if now[m] < best:
            best, cut, j = now[m], [], m
            for origin in reversed(steps):
                cut.append(j)
                j = int(origin[j])
            choices = sorted(cut)
    return [int(tops[j - 1]) for j in choices]


def _apart(rows: DataFrame) -> DataFrame:
    """Rows of one digest and length get digests of their own: the first keeps its own, others add their number.

    Rows are numbered in the part they were written in, after those of the parts before, so
    however often one is repeated, no task has more of them than a part. Which of several
    equal rows gets which number does not matter.
    """
    same = ["digest", "n_tokens", "part"]
    before = Window.partitionBy("digest", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("held"))
    starts = starts.withColumn("first", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    number = F.row_number().over(Window.partitionBy(*same).orderBy("doc_id")) - 1
    numbered_rows = rows.withColumn("number", number).join(starts, same)
    use = F.col("first") + F.col("number")
    other = F.md5(F.concat_ws("/", "digest", use.cast("string")))
    return numbered_rows.withColumn("digest", F.when(use == 0, F.col("digest")).otherwise(other)).drop("number", "first")


def pack(
    docs: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, apart: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, bucket, bucket_len, batch, slot``.

    Tokens are words; a null or empty text has none and lies in the first bucket. The
    histogram of all lengths decides the boundaries. A batch holds as many texts as fit
    into ``batch_tokens`` when each is padded to the bucket's length, or a single text
    that is longer by itself; only the last batch of a bucket may hold fewer. Batches are
    numbered from 0 in each bucket, texts in a batch by ``slot``. Texts stay whole.
    Repeated rows and null doc_ids are rows like others. Texts lie in the order of a hash
    of their doc_id, so those of one doc_id are neighbours; with ``apart`` each has a place
    of its own, as a document that a mix uses several times should. Other columns are not
    read.

    The driver sees the histogram: one row per cell, about 256 for each power of two.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5("text")), F.lit("")))
    part = F.spark_partition_id().alias("part")
    rows = stage(docs.select("doc_id", word_count().alias("n_tokens"), key.alias("digest"), part))
    if apart:
        rows = stage(_apart(rows))
    cells = (
        rows.groupBy(F.expr(CELL).alias("cell"))
        .agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))
        .collect()
    )
    cells = sorted((c["top"], c["n"], c["tokens"]) for c in cells)
    ends = best_boundaries(*(list(x) for x in zip(*cells, strict=True)), buckets) if cells else [0]
    passed = [(F.col("n_tokens") > end).cast("int") for end in ends]
    bucket = sum(passed[1:], passed[0])
    length = F.element_at(F.array(*[F.lit(end).cast("long") for end in ends]), F.col("bucket") + 1)
    held = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.lit(1), F.col("bucket_len"))))
    placed = numbered(
        rows.withColumn("bucket", bucket).withColumn("bucket_len", length), ["bucket"], "digest", ["doc_id", "n_tokens"]
    )
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(F.col("place") / held).alias("batch"),
        F.pmod(F.col("place"), held).cast("int").alias("slot"),
    )
