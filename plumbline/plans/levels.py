"""Columns of any type as a few levels: categories as they are, numbers cut at quantiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.columns import families, number, quoted
from plumbline.plans.ranks import bucket_sql, column_quantiles, sketched

TEXT_BYTES = 64  # a longer text is known by its digest


@dataclass(frozen=True)
class Levels:
    """SQL texts that give the level of a row, as a text, and the cut points of numeric columns."""

    texts: dict[str, str]
    bounds: dict[str, list[float]]

    def described(self, column: str, level: str | None) -> str:
        """A level as a reader would write it: ``column = text`` or ``low <= column < high``."""
        if level is None:
            return f"{column} is missing"
        if column not in self.bounds:
            return f"{column} = {level}"
        cuts, at = self.bounds[column], int(level)
        if at == len(cuts):
            return f"{column} >= {cuts[-1]:g}"
        return f"{column} < {cuts[0]:g}" if at == 0 else f"{cuts[at - 1]:g} <= {column} < {cuts[at]:g}"


def column_levels(df: DataFrame, columns: list[str], bins: int, exact: bool = False) -> Levels:
    """Levels of ``columns``; ``df`` has NULL where a value is missing, and so has its level.

    Numbers, dates and times are cut at ``bins`` - 1 even quantiles, sketched ones unless
    ``exact``; the level is the number of distinct cut points at most the value. Texts and
    booleans are levels themselves.
    """
    kinds = families(df)
    cells = {}
    for c in columns:
        if kinds[c] in ("integral", "fractional", "decimal"):
            cells[c] = number(c)
        elif kinds[c] == "datetime":
            cells[c] = f"CAST(unix_micros(CAST({quoted(c)} AS TIMESTAMP)) AS DOUBLE)"
    probs = [i / bins for i in range(1, bins)]
    listed = list(cells.values())
    if exact:
        found = {row["cid"]: row["q"] for row in column_quantiles(df, listed, probs).collect()}
    else:
        found = {i: q for i, (_, q) in enumerate(sketched(df, listed, [probs] * len(listed)))}
    bounds = {c: sorted(set(found.get(i) or [])) for i, c in enumerate(cells)}
    texts = {}
    for c in columns:
        if c in cells:
            cut = bucket_sql(bounds[c], cells[c]) if bounds[c] else "0"
            texts[c] = f"IF({cells[c]} IS NULL, NULL, CAST({cut} AS STRING))"
        else:
            text = f"CAST({quoted(c)} AS STRING)"
            texts[c] = f"IF(octet_length({text}) > {TEXT_BYTES}, sha2({text}, 256), {text})"
    return Levels(texts, bounds)
