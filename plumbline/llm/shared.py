"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of all contracts: space and the control characters 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK_TURNS = 1024  # turns of a conversation that one task takes together


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``df`` has, in any case of letters."""
    longest = max(map(len, df.columns), default=0)
    return [f"c{i}_".ljust(longest + 4, "_") for i in range(n)]


def whole_text(text: str = "text") -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words: A-Z lowered, cut at spaces and the control characters 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def numbered(rows: DataFrame, groups: list[str], digest: str, order: list[str], digits: int = 3) -> DataFrame:
    """``rows`` with ``place``: 0, 1, 2 ... within each group, by ``digest`` and then ``order``.

    No group is gathered in one task: the first hex ``digits`` of the digest cut every
    group into slices, the counts of the slices (16 ** digits a group at most) say where
    each begins, and rows are ranked inside their slice alone. ``groups`` hold no nulls.
    ``rows`` is read twice; give a staged table. Rows equal in all of ``digest`` and
    ``order`` change places freely.
    """
    cut = rows.withColumn("slice", F.substring(digest, 1, digits))
    before = Window.partitionBy(*groups).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*groups, "slice")
        .agg(F.count(F.lit(1)).alias("held"))
        .withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .drop("held")
    )
    inside = Window.partitionBy(*groups, "slice").orderBy(digest, *order)
    return (
        cut.join(starts, [*groups, "slice"])
        .withColumn("place", F.col("start") + F.row_number().over(inside) - 1)
        .drop("slice", "start")
    )


def in_turn_order(conversations: DataFrame) -> DataFrame:
    """``conversations`` with ``at``: ascending numbers over conversations, and turns within them.

    Rows go by conv_id, turn (nulls first), role and text; nulls of all come first. The
    numbers are unique. A conversation is dealt over tasks by blocks of ``BLOCK_TURNS``
    turns, its rows without a turn by the first characters of role and text, so that none
    is gathered in one task; rows of one block are sorted together, and spill. A block
    lies in one task. Null and empty ``role`` and ``text`` are kept as they are.
    """
    head = lambda c: F.when(F.col("turn").isNull(), F.substring(c, 1, 16))
    names = free_names(conversations, 3)
    block, role, text = names
    cut = conversations.withColumns(
        {block: F.floor(F.col("turn") / BLOCK_TURNS), role: head("role"), text: head("text")}
    )
    return (
        cut.repartitionByRange("conv_id", block, role, text)
        .sortWithinPartitions("conv_id", "turn", role, text, "role", "text")
        .drop(*names)
        .withColumn("at", F.monotonically_increasing_id())
    )
