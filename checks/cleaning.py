"""The bounded cleaning loop on a frame that needs every rule once."""

from __future__ import annotations

from checks.base import LABELLED, Checks, labelled, rounded
from checks.quality import scored_sql
from plumbline.operators.clean import auto_clean

CHECKS = Checks()


def dirty(spark, sf_dir):
    """Labelled documents twice, rare labels only, a constant, and half the lengths missing."""
    docs = labelled(spark, sf_dir)
    return docs.unionByName(docs.filter("quality IS NOT NULL")).selectExpr(
        "doc_id", "lang", "n_chars", "nullif(quality, 1) AS low_quality",
        "nullif(toxic, 0) AS toxic", "'doc' AS kind",
        "IF(n_chars < 1400, NULL, n_chars) AS long_chars",
    )


@CHECKS.add(
    "auto_clean_result",
    f"""WITH d AS (SELECT doc_id, lang, n_chars, CASE WHEN n_chars >= 1400 THEN n_chars END AS long_chars
                   FROM {LABELLED})
        SELECT doc_id, lang, n_chars,
               round(coalesce(long_chars, (SELECT quantile_cont(long_chars, 0.5) FROM d)), 6)::DOUBLE
               AS long_chars FROM d""",
)
def auto_clean_result(spark, sf_dir):
    cleaned, _ = auto_clean(dirty(spark, sf_dir))
    return rounded(cleaned)


DIRTY = f"""(SELECT doc_id, lang, n_chars, nullif(quality, 1) AS low_quality, nullif(toxic, 0) AS toxic, 'doc' AS kind,
    CASE WHEN n_chars >= 1400 THEN n_chars END AS long_chars
    FROM (SELECT * FROM {LABELLED} UNION ALL SELECT * FROM {LABELLED} WHERE quality IS NOT NULL))"""
COLUMNS = ["doc_id", "lang", "n_chars", "low_quality", "toxic", "kind", "long_chars"]
# What each rule leaves out before the next is chosen.
STEPS = [
    ("drop_duplicates", "", DIRTY, COLUMNS),
    ("drop_sparse_columns", "low_quality, toxic", f"(SELECT DISTINCT * FROM {DIRTY})", COLUMNS),
    ("drop_constant_columns", "kind", f"(SELECT DISTINCT doc_id, lang, n_chars, kind, long_chars FROM {DIRTY})",
     ["doc_id", "lang", "n_chars", "kind", "long_chars"]),
    ("impute", "long_chars", f"(SELECT DISTINCT doc_id, lang, n_chars, long_chars FROM {DIRTY})",
     ["doc_id", "lang", "n_chars", "long_chars"]),
]


def _step(i: int, rule: str, chosen: str, source: str, columns: list[str]) -> str:
    numbers = [c for c in columns if c not in ("lang", "kind")]
    scored = scored_sql({c: ("", "") for c in columns}, source, numbers)
    return f"SELECT * FROM ({scored} SELECT {i} AS iteration, '{rule}' AS rule, '{chosen}' AS columns, overall AS overall_before FROM scored)"


@CHECKS.add("auto_clean_steps", " UNION ALL ".join(_step(i, *step) for i, step in enumerate(STEPS, 1)))
def auto_clean_steps(spark, sf_dir):
    """Each rule with the score of the frame before it."""
    _, steps = auto_clean(dirty(spark, sf_dir))
    return rounded(steps)
