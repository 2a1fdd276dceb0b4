"""Exact deduplication by skew-safe combining.

Copies are dropped in three steps that all compare whole texts: inside each task, then
inside groups of (digest, salt), then between the winners of the salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from plumbline.llm.shared import SPACE, free_names, whole_text
from plumbline.session import stage

SALTS = 64  # groups that a hot digest is cut into
HOT_SHARE = 4096  # a digest is hot beyond one row in so many; so at most this many are


def _normal() -> Column:
    return F.regexp_replace(whole_text(), SPACE, " ")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _normal().alias("content")).withColumn("digest", F.sha2("content", 256))


def _unhashed(kind: DataType) -> bool:
    """Whether Spark cannot hash values of a type."""
    return any(name in kind.simpleString() for name in ("map<", "variant"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after every run of white space is one space; a null
    text counts as empty, and empty texts are copies of each other. The smallest doc_id
    stays. Rows with one doc_id and equal texts share their decision. A null doc_id is
    never the one that stays unless all of its group are null; then ``keep_id`` is null
    and ``kept`` true. Other columns are not read. No rows give no rows.

    Texts move once. A first pass over digests finds those with more than one row in
    ``HOT_SHARE``; only their groups are salted (by task, so each task sends one row
    per text after its own combining) and combined again. Rows find their group by
    digest, those of hot texts without moving; should two texts ever share a digest, by the text itself.
    """
    keys = stage(_texts(docs).select("doc_id", "digest"))
    floor = keys.count() // HOT_SHARE
    counted = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    hot = stage(counted.filter(F.col("n") > max(floor, 16)).select("digest"))
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(F.lit(-1))
    # At most HOT_SHARE digests are hot, whatever the size of the input.
    marked = (
        _texts(docs)
        .join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
        .withColumn("salt", salt)
    )
    least, size = F.min("doc_id").alias("keep_id"), F.sum("n").alias("n")
    salted = marked.groupBy("digest", "content", "salt").agg(least, F.count(F.lit(1)).alias("n"))
    kept = F.min("keep_id").alias("keep_id")
    whole = salted.filter("salt < 0").select("digest", "content", "keep_id", "n")
    merged = salted.filter("salt >= 0").groupBy("digest", "content").agg(kept, size)
    groups = whole.unionByName(merged).withColumn("check", F.xxhash64("content", F.length("content")))
    winners = stage(groups.drop("content"))

    twice = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    if twice.isEmpty():
        # Rows of hot texts stay where they are and meet their winner there.
        large = winners.join(F.broadcast(hot), "digest", "left_semi")
        small = keys.join(F.broadcast(hot), "digest", "left_anti").join(winners, "digest", "left")
        found = keys.join(F.broadcast(large), "digest").unionByName(small)
    else:  # two texts under one SHA-256 digest: tell them apart by more of their content
        extra = F.xxhash64("content", F.length("content")).alias("check")
        found = _texts(docs).select("doc_id", "digest", extra).join(winners, ["digest", "check"], "left")
    return found.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of equal texts, with all its columns.

    It has the smallest doc_id of its group, or none if all of them are null. Among rows
    with one doc_id and equal texts, the one with the least hash of all columns stays.
    Rows are matched by doc_id and digest, so what happens to a row depends on its text,
    never on another text under the same doc_id.
    """
    digest, gone_id, gone_digest, order = free_names(docs, 4)
    names = [F.col(f"`{name}`") for name in docs.columns]
    groups = exact_groups(docs).groupBy("doc_id", "text_sha256", "kept").agg(F.count(F.lit(1)).alias("n"))
    groups = stage(groups.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_digest), "kept", "n"))
    rows = docs.withColumn(digest, F.sha2(_normal(), 256))
    same = (F.col(digest) == F.col(gone_digest)) & F.col("doc_id").eqNullSafe(F.col(gone_id))
    gone = groups.filter("NOT kept").select(gone_id, gone_digest)
    rows = rows.join(gone, same, "left_anti")
    several = groups.filter("kept AND n > 1").select(gone_id, gone_digest)
    if several.isEmpty():
        return rows.select(*names)
    # Rows that share doc_id and text are combined in their tasks first.
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not _unhashed(f.dataType)]
    one = (
        rows.join(several, same, "left_semi")
        .groupBy(digest)
        .agg(F.min_by(F.struct(*names), F.xxhash64(*plain)).alias(order))
        .select(f"{order}.*")
    )
    return rows.join(several, same, "left_anti").select(*names).unionByName(one)


EXACT_SQL = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t"""
