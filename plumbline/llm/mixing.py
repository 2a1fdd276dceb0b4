"""Mixing sources: temperature weights realised as budgeted block permutations.

DataFrame functions only; the driver sees one row of totals per round of the bisection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import free_names, word_count
from plumbline.session import stage

BLOCK_DIGITS = 2  # hex digits of a block's number: 256 blocks a source
SLICE_DIGITS = 3  # a block that the budget cuts is summed in 4096 slices
LEVELS = 6  # halvings per round: 63 exponents are tried in one job
ROUNDS = 6
MAX_REPETITION = 2.0


def _measure(name: str) -> Column:
    """What falls as the exponent ``x`` rises, from the shares ``q``."""
    if name == "repetition":
        return F.pow(F.max("q") / F.min("q"), 1 - F.first("x"))
    z = F.sum(F.pow("q", "x"))
    return F.log(z) - F.first("x") * F.sum(F.pow("q", "x") * F.log("q")) / z


def bisect_exponent(shares: DataFrame, measure: str, target: float) -> float:
    """The exponent in [0, 1] at which ``measure`` comes down to ``target``.

    0 if it is not above the target even there; 1 if it still is above at 1. Each round
    halves the bracket ``LEVELS`` times at once.
    """
    low, high = 0.0, 1.0
    steps = 2**LEVELS
    for _ in range(ROUNDS):
        width = (high - low) / steps
        tries = F.array(*[F.lit(low + width * i) for i in range(steps + 1)])
        values = (
            shares.select("q", F.posexplode(tries).alias("i", "x"))
            .groupBy("i")
            .agg(_measure(measure).alias("value"))
            .filter(F.col("value") > target)
            .agg(F.max("i").alias("above"))
            .first()
        )
        above = values["above"]
        if above is None:
            return low
        if above == steps:
            return high
        low, high = low + width * above, low + width * (above + 1)
    return high


def _identity() -> Column:
    """Rows of one doc_id are one document; without a doc_id, rows of one text are."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    return F.md5(F.concat(name, F.lit("/mix")))


def mix(
    docs: DataFrame,
    max_repetition: float | None = MAX_REPETITION,
    target_entropy: float | None = None,
) -> DataFrame:
    """One row per use of a document: ``doc_id, source, n_tokens, weight, pass, block, turn``.

    Tokens are words. The weight of a source is its share of the tokens to the power x,
    over the sum of these; x is 1 for natural shares and 0 for equal ones. It is the
    smallest that keeps the most repeated source within ``max_repetition`` passes, or
    the one whose entropy (in nats) is ``target_entropy``.

    The budget is the smallest in which every source is used once at least, so no
    document is dropped; sources below their weight are repeated. Each pass over a source
    is a permutation of its blocks. The last pass stops at the budget: inside the block
    that crosses it, documents are taken in a permuted order while they fit.
    ``turn`` in [0, 1) orders blocks of all sources so that any run of turns has the weights.

    A null source is a source of its own, and so is an empty one. Documents without
    words are used once in pass 0 and again with their block. Sources without any word
    have weight 0 and one pass. Repeated rows and null doc_ids are documents like
    others. Other columns are not read. No rows give no rows.
    """
    return _uses(docs, max_repetition, target_entropy).drop("digest")


def repeat(
    docs: DataFrame,
    max_repetition: float | None = MAX_REPETITION,
    target_entropy: float | None = None,
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix uses its document."""
    uses = _uses(docs, max_repetition, target_entropy).groupBy("digest").agg((F.max("pass") + 1).alias("uses"))
    digest, number, use = free_names(docs, 3)
    uses = uses.select(F.col("digest").alias(digest), F.col("uses").alias(number))
    again = F.explode(F.sequence(F.lit(1), F.col(number)))
    named = docs.withColumn(digest, _identity()).join(uses, digest).withColumn(use, again)
    return named.select(*[F.col(f"`{name}`") for name in docs.columns])


def _uses(docs: DataFrame, max_repetition: float | None, target_entropy: float | None) -> DataFrame:
    rows = stage(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"),
            word_count().alias("n_tokens"),
            _identity().alias("digest"),
        ).withColumn("block", F.substring("digest", 1, BLOCK_DIGITS))
    )
    blocks = stage(rows.groupBy("key", "block").agg(F.sum("n_tokens").alias("held")))
    sources = stage(blocks.groupBy("key").agg(F.sum("held").alias("total")))
    total = sources.agg(F.sum("total")).first()[0] or 0
    shares = sources.filter("total > 0").withColumn("q", F.col("total") / F.lit(float(max(total, 1))))
    if target_entropy is not None:
        x = bisect_exponent(shares, "entropy", target_entropy)
    else:
        x = bisect_exponent(shares, "repetition", max_repetition)
    power = F.pow("q", F.lit(x))
    sums = shares.agg(F.sum(power).alias("z"), F.max(F.col("total") / power).alias("b")).first()
    z, budget = (sums["z"] or 1.0), (sums["b"] or 0.0)  # budget * z is the number of tokens of the whole mix

    weighted = shares.select("key", "total", (power / F.lit(z)).alias("weight"), (power * budget).alias("budget"))
    weighted = weighted.unionByName(
        sources.filter("total = 0").select("key", "total", F.lit(0.0).alias("weight"), F.lit(0.0).alias("budget"))
    )
    # A thousandth of a token is far above rounding and far below what matters.
    count = F.greatest(F.lit(1), F.ceil((F.col("budget") - 0.001) / F.greatest(F.col("total"), F.lit(1)))).cast("int")
    passes = weighted.withColumn("pass", F.explode(F.sequence(F.lit(0), count - 1))).withColumn(
        "room",
        F.when(F.col("pass") == 0, F.col("total")).otherwise(
            F.least(F.col("total"), F.floor(F.col("budget") - F.col("pass") * F.col("total") + 0.001))
        ),
    )
    order = F.md5(F.concat_ws("/", "key", "block", F.col("pass").cast("string")))
    before = (
        Window.partitionBy("key", "pass").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    )
    plan = (
        blocks.join(passes, "key")
        .withColumn("order", order)
        .withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .filter((F.col("pass") == 0) | (F.col("before") < F.col("room")))
        .withColumn("cut", F.col("before") + F.col("held") > F.col("room"))
        .withColumn(
            "turn",
            F.when(
                F.col("budget") > 0, (F.col("pass") * F.col("total") + F.col("before")) / F.col("budget")
            ).otherwise(0.0),
        )
    )
    used = rows.join(plan, ["key", "block"])
    whole = used.filter("NOT cut")
    # The block that crosses the budget grows with its source, so it is summed in slices of its permutation.
    cut = (
        used.filter("cut")
        .withColumn("shuffled", F.md5(F.concat_ws("/", "digest", F.col("pass").cast("string"))))
        .withColumn("slice", F.substring("shuffled", 1, SLICE_DIGITS))
    )
    earlier = Window.partitionBy("key", "block", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("key", "block", "pass", "slice")
        .agg(F.sum("n_tokens").alias("sliced"))
        .withColumn("start", F.coalesce(F.sum("sliced").over(earlier), F.lit(0)))
        .drop("sliced")
    )
    upto = (
        Window.partitionBy("key", "block", "pass", "slice")
        .orderBy("shuffled", "doc_id", "n_tokens")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    part = (
        cut.join(starts, ["key", "block", "pass", "slice"])
        .withColumn("upto", F.col("start") + F.sum("n_tokens").over(upto))
        .filter(F.col("before") + F.col("upto") <= F.col("room"))
    )
    wanted = ["digest", "doc_id", "source", "n_tokens", "weight", "pass", "block", "turn"]
    return whole.select(*wanted).unionByName(part.select(*wanted))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
         md5(coalesce(doc_id::VARCHAR, md5(text), '') || '/mix') AS g FROM documents),
b AS (SELECT k, substr(g, 1, 2) AS block, sum(n)::BIGINT AS held FROM d GROUP BY ALL),
s AS (SELECT k, sum(held)::BIGINT AS total FROM b GROUP BY k),
q AS (SELECT k, total, total / (SELECT sum(total) FROM s) AS q FROM s WHERE total > 0),
x AS (SELECT CASE WHEN max(q) / min(q) <= 2 THEN 0 ELSE 1 - ln(2.0) / ln(max(q) / min(q)) END AS x FROM q),
z AS (SELECT sum(pow(q, x)) AS z, max(total / pow(q, x)) AS m FROM q, x),
w AS (SELECT k, total, pow(q, x) / z AS weight, pow(q, x) * m AS budget FROM q, x, z
      UNION ALL SELECT k, total, 0.0, 0.0 FROM s WHERE total = 0),
p AS (SELECT *, unnest(range(0, greatest(1, ceil((budget - 0.001) / greatest(total, 1))::BIGINT))) AS pass FROM w),
r AS (SELECT *, CASE WHEN pass = 0 THEN total ELSE least(total, floor(budget - pass * total + 0.001)) END AS room FROM p),
t AS (SELECT r.*, b.block, b.held,
        coalesce(sum(b.held) OVER (PARTITION BY r.k, r.pass ORDER BY md5(r.k || '/' || b.block || '/' || r.pass)
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN b USING (k)),
u AS (SELECT d.doc_id, d.source, d.n, t.*, sum(d.n) OVER (PARTITION BY t.k, t.block, t.pass
        ORDER BY md5(d.g || '/' || t.pass), d.doc_id, d.n ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON t.k = d.k AND t.block = substr(d.g, 1, 2) WHERE t.pass = 0 OR t.before < t.room)
SELECT doc_id, source, n AS n_tokens, round(weight, 6) AS weight, pass::INTEGER AS pass, block,
       CASE WHEN budget > 0 THEN round((pass * total + before) / budget, 6) ELSE 0.0 END AS turn
FROM u WHERE before + held <= room OR before + upto <= room"""
