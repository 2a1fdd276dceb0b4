"""Texts cut at lines into prefix, middle and suffix, and put together for infilling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # the fixed marks of the output
LANE_BITS = 2  # a tower reaches the next lane with chance 1 / 2 ** LANE_BITS
ROWS = 500  # texts cut at a time
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def tower_heights(n: int) -> np.ndarray:
    """The lanes above the ground lane that the tower before each of ``n`` units reaches.

    A hash of the rank draws them, so the same list is built anywhere; the first tower is
    the head of the list and reaches every lane.
    """
    h = np.arange(n, dtype=np.uint64) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    height = np.zeros(n, np.int64)
    for lane in range(1, 1 + n.bit_length() // LANE_BITS):
        height += (h & np.uint64((1 << lane * LANE_BITS) - 1)) == 0
    if n:
        height[0] = height.max()
    return height


class Units:
    """An indexable skip list over the units of one text.

    Every link of every lane carries two widths: the units and the code points it passes.
    ``chars_before(rank)`` goes down the lanes and follows a link while the units passed
    stay within the rank, so it passes few links of each lane.
    """

    def __init__(self, lengths: np.ndarray, heights: np.ndarray):
        self.n = len(lengths)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.lanes = []  # from the ground up: units, code points, the link below each tower
        below = np.arange(self.n + 1)
        for lane in range(int(heights.max(initial=0)) + 1):
            towers = np.append(np.flatnonzero(heights >= lane), self.n)
            self.lanes.append((np.diff(towers).tolist(), np.diff(ends[towers]).tolist(), below[towers].tolist()))
            below = np.zeros(self.n + 1, np.int64)
            below[towers] = np.arange(len(towers))

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        units = chars = at = 0
        for widths, points, below in reversed(self.lanes):
            while at < len(widths) and units + widths[at] <= rank:
                units += widths[at]
                chars += points[at]
                at += 1
            at = below[at]
        return chars


def line_lengths(text: str) -> list[int]:
    """Code points of each line, its line break included; a last line may have none."""
    lengths = [len(line) + 1 for line in text.split("\n")]
    lengths[-1] -= 1
    return lengths if lengths[-1] else lengths[:-1]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned numbers of 32 bits that only seed and doc_id decide (null: no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


class Cutter:
    """Cuts texts; heights of towers are drawn once for the longest text seen."""

    def __init__(self, fim_rate: int, spm_rate: int, seed: int):
        self.fim_rate, self.spm_rate, self.seed = fim_rate, spm_rate, seed
        self.heights = tower_heights(1024)

    def __call__(self, doc_id: int | None, text: str) -> tuple:
        """``n, form, prefix_chars, middle_chars, output``"""
        lengths = line_lengths(text)
        n = len(lengths)
        h1, h2, h3, h4 = draws(doc_id, self.seed)
        if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= self.fim_rate:
            return n, "plain", None, None, text
        if n > len(self.heights):
            self.heights = tower_heights(2 * n)
        units = Units(np.array(lengths, np.int64), self.heights[:n])
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = units.chars_before(first), units.chars_before(second)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < self.spm_rate:
            form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
        else:
            form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
        return n, form, a, b - a, "".join(parts)


def infill(docs: DataFrame, fim_rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of ``docs``.

    Units are lines. Two ranks drawn from seed and doc_id cut a text; ``fim_rate`` percent
    of the texts are cut, ``spm_rate`` percent of those with the suffix first. Empty texts
    and texts that hold a mark stay ``plain``, with null lengths. A null text is empty, a
    null doc_id is written with no digits. Repeated rows are rows of their own and get the
    same cuts, as do other texts of the same doc_id with as many lines. Other columns are
    not read. No rows give no rows. Every text is cut in one go, whatever its length; no
    row meets another, so nothing is shuffled.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(fim_rate, spm_rate, seed)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):  # few cut texts are held beside the batch
                part = batch.slice(start, ROWS)
                ids, texts = part["doc_id"], part["text"].to_pylist()
                found = [cutter(i, t or "") for i, t in zip(ids.to_pylist(), texts, strict=True)]
                n, form, prefix, middle, output = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from, found by its marks alone.

    A mark begins with its only ``<``, so no mark can arise where two parts meet.
    """
    text = F.col(output)

    def between(start: Column, end: Column) -> Column:
        return F.substring(text, start, end - start)

    p, s, m = (F.locate(mark, text) for mark in (PREFIX, SUFFIX, MIDDLE))
    width = F.lit(len(PREFIX))
    middle = between(m + width, F.char_length(text) + 1)
    psm = F.concat(between(p + width, s), middle, between(s + width, m))
    spm = F.concat(between(p + width, m), middle, between(s + width, p))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(text)


INFILL_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
    SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines,
           [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r
    FROM d
), c AS (
    SELECT doc_id, text, r, len(lines) AS n,
           text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
           array_to_string(lines[:least(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1))], '') AS prefix,
           array_to_string(lines[least(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) + 1
                                 : greatest(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1))], '') AS middle,
           array_to_string(lines[greatest(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) + 1 :], '') AS suffix
    FROM u
), f AS (
    SELECT *, CASE WHEN plain THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN NOT plain THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN NOT plain THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""
