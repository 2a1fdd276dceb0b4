"""Documents that every operator must take, and small helpers."""

from __future__ import annotations

import random

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Columns whose names the operators use inside or give out.
    "kept boolean, digest string, id long, node long, bucket int, slot int, key string, n long, place long, part int, "
    "__guess string, __digest string, __uses int, gone_id long, slice string, start long, c0_ int"
)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    base = words(rng, 60)
    near = [*base[:30], "changed", *base[31:]]
    texts = [
        (1, " ".join(base)),
        (2, "  ".join(base) + "\n"),  # equal but for white space
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \t\n"),
        (7, "12345 !!"),
        (8, "Two words"),
        (9, "Two words"),
        (10, " ".join(words(rng, 30_000))),  # very long
        (11, "x" * 200_000),  # one very long word
        (None, "no id here at all my friend"),
        (None, " ".join(base)),
        (13, "repeated row of some words"),
        (13, "repeated row of some words"),
        (14, "écrit à Zoë: zoe@example.com, 10.0.0.1 (10.0.0.1)"),
        (15, "Released under the MIT License."),
        (16, "\U0001F600 smile \U0001F600\x85\x1c words"),
    ]
    langs = ["en", None, "fr"]
    sources = ["a", None, "", "b"]
    extra = (True, "x", 1, 2, 3, 4, "k", 5, 6, 7, "g", "d", 8, 1, "s", 9, 10)
    return [(d, t, langs[i % 3], sources[i % 4], None, *extra) for i, (d, t) in enumerate(texts)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, texts: list[tuple], more: str = ""):
    return spark.createDataFrame(texts, "doc_id long, text string" + more)


def table(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]
