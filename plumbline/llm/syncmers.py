"""Document fingerprints from closed syncmers of words.

DataFrame functions only. A k-mer of words is an anchor when the smallest hash among its
inner s-mers is at its first or last place. That depends on the k-mer alone, so equal
passages have equal anchors wherever they stand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import SPACE, whole_text

S = 2  # words of an inner s-mer
K = 6  # words of a k-mer, a multiple of S
ROWS_KEPT = 4  # buckets of neighbours per shuffle partition
BLANK = " \t\n\r\x0b\x0c"


def with_anchors(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the anchors of ``text`` in order, as structs ``hash, place``.

    ``place`` is the first word of the k-mer, from 0. A text of fewer words than a k-mer,
    or in which no k-mer is chosen, has one anchor, the hash of all its words; only one
    without words has none. Hashes have 64 bits.
    """
    words, inner = f"{name}__words", f"{name}__inner"
    bare = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANK))
    rows = rows.withColumn(words, F.when(bare != "", F.split(bare, SPACE)).otherwise(F.array().cast("array<string>")))
    pieces = ", ".join(f"`{words}`[i + {j}]" for j in range(S))
    rows = rows.withColumn(
        inner,
        F.expr(
            f"IF(size(`{words}`) >= {K}, transform(sequence(0, size(`{words}`) - {S}), i -> xxhash64({pieces})), "
            "CAST(array() AS array<bigint>))"
        ),
    )
    at = [f"`{inner}`[i + {j}]" for j in range(K - S + 1)]
    whole = ", ".join(at[::S])
    edge = f"least({', '.join(at)}) IN ({at[0]}, {at[-1]})"
    whole_words = f"array(named_struct('hash', xxhash64(`{words}`), 'place', 0))"
    rows = rows.withColumn(
        name,
        F.expr(
            f"""CASE WHEN size(`{words}`) >= {K} THEN filter(
                  transform(sequence(0, size(`{words}`) - {K}), i ->
                    IF({edge}, named_struct('hash', xxhash64({whole}), 'place', i), NULL)), a -> a IS NOT NULL)
                WHEN size(`{words}`) > 0 THEN {whole_words}
                ELSE CAST(array() AS array<struct<hash: bigint, place: int>>) END"""
        ),
    )
    rows = rows.withColumn(name, F.expr(f"IF(size(`{name}`) = 0 AND size(`{words}`) > 0, {whole_words}, `{name}`)"))
    return rows.drop(words, inner)


def as_text(anchors: str) -> Column:
    """The hashes of the anchors in order, sixteen hex digits each."""
    return F.array_join(F.transform(f"{anchors}.hash", lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """The share of the distinct hashes of either's anchors that both have: 0 to 1, and 1 for two texts without words."""
    either, both = (f(F.col(f"{a}.hash"), F.col(f"{b}.hash")) for f in (F.array_union, F.array_intersect))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(both) / F.size(either))


def matches(a: str, b: str) -> Column:
    """All pairs of places at which two texts share an anchor: ``here, there, hash`` in the order of ``a``, then of ``b``."""
    pair = "named_struct('here', x.place, 'there', y.place, 'hash', x.hash)"
    return F.expr(f"flatten(transform(`{a}`, x -> transform(filter(`{b}`, y -> y.hash = x.hash), y -> {pair})))")


def _bucketed(docs: DataFrame, buckets: int) -> tuple[Column, DataFrame]:
    """The bucket of a row by its ``ord``, of about equal row counts; rows with one ``ord`` share it."""
    probs = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx("ord", probs, 100 * buckets)).first()[0] if probs else None
    bounds = sorted(set(found or []))
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    tops = "array({})".format(", ".join(f"{p[0]}L" for p in parts[1:]))
    inner = ", ".join("CAST(array({}) AS array<bigint>)".format(", ".join(f"{b}L" for b in p)) for p in parts)
    docs = docs.withColumn("part", F.expr(f"size(filter(CAST({tops} AS array<bigint>), b -> b <= ord))"))
    bucket = F.expr(f"part * {step + 1} + size(filter(array({inner})[part], b -> b <= ord))")
    return docs.withColumn("bucket", bucket).drop("part")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of every row, with ``next_text`` of the row that follows.

    Rows are ordered by doc_id; null ids come last, rows with one id by a hash of the
    text. The last is followed by the first. Buckets of neighbouring ids are sorted in
    tasks of their own; the first row of each is also sent to the bucket before it.
    """
    spark = docs.sparkSession
    buckets = ROWS_KEPT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        "doc_id", whole_text().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ord")
    )
    rows = _bucketed(rows, buckets)
    # One first id per bucket: as many as the cluster is set to have partitions, times ROWS_KEPT.
    firsts = sorted((r["first"], r["bucket"]) for r in rows.groupBy("bucket").agg(F.min("ord").alias("first")).collect())
    rows = rows.withColumn("guest", F.lit(False))
    if firsts:
        to = ", ".join(f"({first}L, {firsts[i - 1][1]})" for i, (first, _) in enumerate(firsts))
        guests = spark.sql(f"SELECT * FROM VALUES {to} AS t(first, host)")
        copied = rows.join(F.broadcast(guests), F.col("ord") == F.col("first"))
        copied = copied.select("doc_id", "text", "ord", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
        rows = rows.unionByName(copied)
    following = Window.partitionBy("bucket").orderBy("guest", "ord", F.xxhash64("text"))
    return rows.withColumn("next_text", F.lead("text").over(following)).filter("NOT guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, anchors, edited_anchors``.

    The edited text has its last quarter replaced by as much of the beginning of the next
    document. ``anchors`` and ``edited_anchors`` hold every anchor of the whole text with
    its place, in order, and ``fingerprint`` and ``edited_fingerprint`` all their hashes; only texts
    without words have none. ``near_edited`` and ``near_next`` are exact over the distinct hashes of
    all anchors; two texts without words are alike (1). A lone document is followed by
    itself. Other columns are not read. No rows give no rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr(
        "concat(substring(text, 1, CAST(n_chars - n_chars DIV 4 AS INT)), substring(next_text, 1, CAST(n_chars DIV 4 AS INT)))"
    )
    rows = rows.withColumn("edited", edited)
    rows = with_anchors(rows, "text", "anchors").drop("text")
    rows = with_anchors(rows, "next_text", "next_anchors").drop("next_text")
    rows = with_anchors(rows, "edited", "edited_anchors")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("anchors").alias("fingerprint"),
        as_text("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
        "anchors",
        "edited_anchors",
    )
