"""Conversations whose turns do not alternate, repaired at least cost.

The legal sequences of role initials, ``(s?(ua)+)?``, are made a grammar in Chomsky normal
form: a symbol (p, q) stands for what leads from place p of a legal sequence to place q,
its rules are (p, q) -> (p, r) (r, q), and the edits of one row are its terminal rules.
Insertions make rules without a row; their closure is put before every row and at the
end. A cell holds the least (cost, audit) of its span for every symbol.

Because a symbol names both its ends, every split of a span gives the same cell: the sets
of edits are the same, and costs add. So the chart needs one split of each span. Spans
are joined bottom-up by length, in pairs of equal length, and a conversation of any length
takes as many cells as it has rows. Audits of one span hold one letter for each row, so none is
a part of another's beginning with less cost, and the least audits join to the least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import in_turn_order
from plumbline.session import stage

# Fixed values of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NO_SPACE = "[^\\x20\\x09-\\x0D]"

# Places of a legal sequence: at the start, after s, after u, after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
PLACES, ENDS = range(4), (0, 3)
SEGMENT_BITS = 8  # rows whose cells one task joins first

Cell = tuple  # 16 entries, for (p, q) at 4 * p + q: (cost, audit), or None


def _least(options: Iterable) -> tuple | None:
    return min((o for o in options if o is not None), default=None)


def join(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two parts, by every rule (p, q) -> (p, r) (r, q)."""
    made = []
    for p in PLACES:
        for q in PLACES:
            pairs = ((left[4 * p + r], right[4 * r + q]) for r in PLACES)
            made.append(_least((a[0] + b[0], a[1] + b[1]) for a, b in pairs if a is not None and b is not None))
    return tuple(made)


def _cell(steps: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(steps.get((p, q)) for p in PLACES for q in PLACES)


def _closure() -> Cell:
    """Insertions of any number of empty turns, of which a few are enough to reach any place."""
    none = {(p, p): (0, "") for p in PLACES}
    one = {(p, q): (INSERT, "I") for (p, role), q in STEPS.items() if role != "s"}
    once = _cell(none | one)
    return reduce(join, [once] * len(PLACES))


EMPTY = _cell({(p, p): (0, "") for p in PLACES})
INSERTED = _closure()


@lru_cache(maxsize=None)  # a code is one of 16
def row_cell(code: str) -> Cell:
    """The cell of one row, insertions before it included, by its code (see :func:`codes`)."""
    bits = int(code, 16)
    kept, must_go, cut = "oua"[bits & 3] if bits & 3 < 3 else "s", bits >> 2 & 1, bits >> 3
    steps = {(p, p): (DELETE, "D") for p in PLACES}
    if not must_go:
        extra = TRUNCATED * cut
        for (p, role), q in STEPS.items():
            if role != "s":
                steps[p, q] = (REROLE + extra, "R")
        for (p, role), q in STEPS.items():
            if role == kept:
                steps[p, q] = (extra, "K")
    return join(INSERTED, _cell(steps))


@lru_cache(maxsize=4096)  # short sequences of codes, which most conversations share
def _joined(codes: str) -> Cell:
    return Spans(map(row_cell, codes)).cell()


class Spans:
    """Cells of neighbouring spans, joined in pairs of equal length as they come."""

    def __init__(self, cells: Iterable[Cell] = ()):
        self.held: list[tuple[int, Cell]] = []
        for cell in cells:
            self.add(cell)

    def add(self, cell: Cell) -> None:
        length = 1
        while self.held and self.held[-1][0] == length:
            _, before = self.held.pop()
            cell, length = join(before, cell), 2 * length
        self.held.append((length, cell))

    def cell(self) -> Cell:
        whole = EMPTY
        for _, cell in reversed(self.held):
            whole = join(cell, whole)
        return whole


def span_cell(codes: str) -> Cell:
    return _joined(codes) if len(codes) <= 16 else Spans(map(row_cell, codes)).cell()


def best(cell: Cell) -> tuple[int, str]:
    """The least cost and audit of a whole conversation, insertions at its end included."""
    closed = join(cell, INSERTED)
    return _least(closed[q] for q in ENDS)


# ---- rows ---------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, lost``: rows damaged by crc32 of ``conv_id:turn``.

    Of the remainder by 20, 0 loses the row (it stays, marked ``lost``, so that its
    conversation is known), 1 empties the text, 2 takes its full stops, exclamation and
    question marks, 3 repeats the row, 4 makes it a user's. Nulls of ``role`` and ``text``,
    and of the numbers inside the hashed text, are one space. Repeated rows share their damage.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), part("role").alias("role"),
        part("text").alias("text"), how.alias("how"),
    )
    text = F.when(F.col("how").isin(0, 1), "").when(F.col("how") == 2, F.translate("text", ".!?", ""))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("how") == 3, 1).otherwise(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"), (F.col("how") == 0).alias("lost"), copies.alias("copy"),
    ).drop("copy")


def codes() -> Column:
    """A row as a hex digit: its initial (0 other, 1 u, 2 a, 3 s), 4 if it must go, 8 if it is cut off.

    Whether a row repeats an earlier one is not known yet, and adds 4 later.
    """
    blank = ~F.col("text").rlike(NO_SPACE)
    cut_off = ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "u", 1).when(initial == "a", 2).when(initial == "s", 3).otherwise(0)
    return (code + F.when(blank, 4).when(cut_off, 8).otherwise(0)).cast("int")


class Turns(NamedTuple):
    """What is known of a span beside its cell."""

    rows: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: int  # initials of the first and last row, -1 without rows
    last: int
    low: int | None  # turns, which rise; None without any
    high: int | None
    distinct: int

    def __add__(self, other: "Turns") -> "Turns":
        if not other.rows:
            return self
        if not self.rows:
            return other
        meet = self.high is not None and self.high == other.low
        return Turns(
            *(a + b for a, b in zip(self[:4], other[:4], strict=True)),
            self.illegal + other.illegal + _clash(self.last, other.first),
            self.first, other.last,
            other.low if self.low is None else self.low,
            self.high if other.high is None else other.high,
            self.distinct + other.distinct - meet,
        )


NO_TURNS = Turns(0, 0, 0, 0, 0, -1, -1, None, None, 0)


def _clash(before: int, after: int) -> bool:
    """Whether two neighbouring initials are other than su, ua, au."""
    return (before, after) not in ((3, 1), (1, 2), (2, 1))


def _summary(members: list, repeats: set[int]) -> tuple[list[int], str, Turns]:
    """The rows ``(at, code, turn, lost)`` of a segment, in order: numbers, codes, counts."""
    ats, digits, found = [], [], NO_TURNS
    for at, code, turn, lost in members:
        if lost:
            continue
        initial, blank = code & 3, code >> 2 & 1
        duplicate = not blank and at in repeats
        cut = not blank and not duplicate and code >> 3
        ats.append(at)
        digits.append("0123456789abcdef"[initial + 4 * (blank or duplicate) + 8 * cut])
        known = turn is not None
        found += Turns(1, blank, int(duplicate), int(cut), 0, initial, initial, turn, turn, int(known))
    return ats, "".join(digits), found


SEGMENTS = (
    "conv_id long, segment long, ats array<long>, costs array<int>, audits array<string>,"
    f" {', '.join(f'{name} long' for name in Turns._fields)}"
)


def _parse_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for conv, segment, members, firsts in zip(
            batch["conv_id"], batch["segment"], batch["members"], batch["firsts"], strict=True
        ):
            rows = sorted((m["at"], m["code"], m["turn"], m["lost"]) for m in members)
            firsts = set(firsts)
            ats, digits, found = _summary(rows, {at for at, *_ in rows if at not in firsts})
            cell = span_cell(digits)
            costs = [-1 if c is None else c[0] for c in cell]
            audits = ["" if c is None else c[1] for c in cell]
            made.append((conv, segment, ats, costs, audits, *found))
        columns = ["conv_id", "segment", "ats", "costs", "audits", *Turns._fields]
        frame = pd.DataFrame(made, columns=columns)
        yield frame.astype({c: "Int64" for c in ("conv_id", "segment", *Turns._fields)})


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
EDITS = "edits array<struct<at:long,edit:string,before:long>>"


def _edits(audit: str, ats: list[int]) -> list[dict]:
    """The letters of each row, inserted turns before it (after the last, too) among them."""
    made, start, before = [], 0, 0
    for i, at in enumerate(ats):
        end = start
        while audit[end] == "I":
            end += 1
        end = end + 1 if i < len(ats) - 1 else len(audit)
        letters = audit[start:end]
        made.append({"at": at, "edit": letters, "before": before})
        before += len(letters) - letters.count("D")
        start = end
    return made


def _parse_conversations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments in order to conversations: cells joined, the best chosen, its letters dealt to the rows."""
    conv, spans, found, ats = None, None, NO_TURNS, []

    def row() -> tuple:
        cost, audit = best(spans.cell())
        gaps = 0 if found.low is None else found.high - found.low + 1 - found.distinct
        report = (gaps, found.blank, found.duplicate, found.truncated, found.illegal, cost, audit)
        return conv, *report, _edits(audit, ats)

    def frame(made: list) -> pd.DataFrame:
        names = [part.split()[0] for part in REPORT.split(", ")]
        whole = [name for name in names if name != "audit"]
        return pd.DataFrame(made, columns=[*names, "edits"]).astype({name: "Int64" for name in whole})

    for batch in batches:
        made = []
        for line in batch.itertuples(index=False):
            key = None if pd.isna(line.conv_id) else int(line.conv_id)
            if spans is None or key != conv:
                if spans is not None:
                    made.append(row())
                conv, spans, found, ats = key, Spans(), NO_TURNS, []
            spans.add(tuple(None if c < 0 else (int(c), a) for c, a in zip(line.costs, line.audits, strict=True)))
            known = (getattr(line, name) for name in Turns._fields)
            found += Turns(*(None if pd.isna(v) else int(v) for v in known))
            ats.extend(map(int, line.ats))
        yield frame(made)
    if spans is not None:
        yield frame([row()])


class Repair(NamedTuple):
    report: DataFrame
    turns: DataFrame


def repair(conversations: DataFrame) -> Repair:
    """The cheapest repair of every conversation: a report, and its turns as repaired.

    ``conversations`` has ``conv_id, turn, role, text`` and may have ``lost``: rows that are
    not there, and only make their conversation known. Rows go by turn (nulls first),
    then role and text. ``report`` has a row per conv_id (null is one): ``gaps`` in the
    turns, counts of ``blank``, ``duplicate`` and ``truncated`` rows by their first fault, of
    ``illegal`` neighbours, the ``cost`` and the ``audit``, its edits' letters in order. ``turns`` has
    ``conv_id, at, part, role, text, edit``; (at, part) order them, and inserted turns have empty
    texts. Null roles and texts count as one space; a role without an initial s, u or a (an
    empty one, too) cannot be kept. A conversation without rows has zeros and an empty audit.
    Other columns are not read. No rows give no rows.

    Rows are ordered once, over all tasks, and written. Segments of 256 rows are parsed
    apart; a conversation's segments are joined in one task that never sees a text, but holds
    sixteen candidates of its audit.
    """
    lost = F.col("lost") if "lost" in conversations.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"), lost.alias("lost")
    )
    rows = stage(in_turn_order(rows))
    segment = F.shiftright("at", SEGMENT_BITS).alias("segment")
    member = F.struct("at", codes().alias("code"), "turn", "lost")
    light = rows.select("conv_id", segment, member.alias("member"), F.lit(None).cast("long").alias("first"))
    # Of equal role and text, the first row. Digests stand for them, of the whole text.
    same = F.sha2(F.concat_ws("\n", F.octet_length("role"), "role", "text"), 256)
    firsts = rows.filter(~F.col("lost")).groupBy("conv_id", same.alias("same")).agg(F.min("at").alias("at"))
    firsts = firsts.select("conv_id", segment, F.lit(None).cast(light.schema["member"].dataType).alias("member"),
                           F.col("at").alias("first"))
    segments = (
        light.unionByName(firsts)
        .groupBy("conv_id", "segment")
        .agg(F.collect_list("member").alias("members"), F.collect_list("first").alias("firsts"))
        .mapInPandas(_parse_segments, SEGMENTS)
    )
    parsed = stage(
        segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
        .mapInPandas(_parse_conversations, f"{REPORT}, {EDITS}")
    )
    report = parsed.drop("edits")
    return Repair(report, _repaired(rows, parsed))


def _repaired(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every row with its letters, as none, one or several turns."""
    # A legal sequence has an odd number of turns if it begins with s. After s, or an even
    # number of u and a, comes u.
    turns = F.char_length(F.translate("audit", "D", ""))
    dealt = parsed.select((turns % 2).alias("shift"), F.explode("edits").alias("edit")).select("shift", "edit.*")
    row = rows.filter(~F.col("lost")).join(dealt, "at")
    letters = row.select("*", F.posexplode(F.split("edit", "")).alias("part", "letter")).filter("letter <> ''")
    # Turns before this letter: no letter before it in the row but the last can be a D.
    told = F.col("before") + F.char_length(F.translate(F.expr("substring(edit, 1, part)"), "D", ""))
    role = F.when((told - F.col("shift")) % 2 == 0, "user").otherwise("assistant")
    return letters.filter("letter <> 'D'").select(
        "conv_id", "at", "part",
        F.when(F.col("letter") == "K", F.col("role")).otherwise(role).alias("role"),
        F.when(F.col("letter") == "I", "").otherwise(F.col("text")).alias("text"),
        F.col("letter").alias("edit"),
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations whose report comes first and whose turns follow in order."""
    schema, report, digest, many = None, None, None, False
    for batch in batches:
        names = batch.schema.names[:8]
        schema = schema or pa.schema([batch.schema.field(name) for name in names] + [("repaired_sha256", pa.string())])
        done = []
        for row in batch.to_pylist():
            if row["part"] is None:
                if report is not None:
                    done.append(report | {"repaired_sha256": digest.hexdigest()})
                report, digest, many = {name: row[name] for name in names}, hashlib.sha256(), False
            else:
                digest.update(f"{chr(10) * many}{row['role']}:{row['text']}".encode())
                many = True
        yield pa.RecordBatch.from_pylist(done, schema)
    if report is not None:
        yield pa.RecordBatch.from_pylist([report | {"repaired_sha256": digest.hexdigest()}], schema)


def digests(repaired: Repair) -> DataFrame:
    """The report with the digest of the repaired ``role:text`` lines, a chain over a conversation.

    Its turns pass one task in order, which holds a batch and the state of the digest.
    """
    columns = repaired.report.columns
    order = ["at", "part"]
    turns = repaired.turns.select("conv_id", *order, "role", "text")
    rows = repaired.report.unionByName(turns, allowMissingColumns=True).select(*columns, *order, "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return ordered.mapInArrow(_hashed, f"{REPORT}, repaired_sha256 string")


# One row after the other, by place: another way through the same grammar.
REPAIR_SQL = """
WITH RECURSIVE bytes AS (
    SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                ORDER BY b) AS crc
    FROM range(256) r(b)
), hashed AS (
    SELECT c.conv_id, c.turn, coalesce(c.role, ' ') AS role, coalesce(c.text, ' ') AS text,
           xor(list_reduce([4294967295::BIGINT] || list_transform(
                   string_split(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(c.turn::VARCHAR, ' '), ''),
                   lambda x: ascii(x)::BIGINT),
               lambda h, x: xor(h >> 8, crc[(xor(h, x) & 255) + 1])), 4294967295) % 20 AS how
    FROM conversations c, bytes
), damaged AS (
    SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
           CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM hashed, range(2) copies(k) WHERE how <> 0 AND (k = 0 OR how = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), seen AS (
    SELECT *, left(role, 1) AS c, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM placed
), faults AS (
    SELECT *, t = '' AS is_blank, t <> '' AND again AS is_copy, t <> '' AND NOT again AND right(t, 1) NOT IN ('.', '!', '?') AS is_cut
    FROM seen
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count_if(is_blank) AS blank, count_if(is_copy) AS duplicate, count_if(is_cut) AS truncated,
           count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
), steps(p, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), inserted(p, q, k) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2)
), edits AS (
    SELECT conv_id, i, p, q, 5 * is_cut::INT AS cost, 'K' AS letter FROM faults JOIN steps USING (c) WHERE NOT is_blank AND NOT is_copy
    UNION ALL
    SELECT conv_id, i, p, q, 1 + 5 * is_cut::INT, 'R' FROM faults, steps WHERE NOT is_blank AND NOT is_copy AND steps.c <> 's'
    UNION ALL
    SELECT conv_id, i, p, p, 2, 'D' FROM faults, range(4) places(p)
), moves AS (
    SELECT e.conv_id, e.i, s.p, e.q, min({'cost': 5 * s.k + e.cost, 'audit': repeat('I', s.k) || e.letter}) AS best
    FROM edits e JOIN inserted s ON s.q = e.p GROUP BY ALL
), chart AS (
    SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS q, {'cost': 0, 'audit': ''} AS best FROM counted
    UNION ALL
    SELECT b.conv_id, b.i + 1, m.q::BIGINT, min({'cost': b.best.cost + m.best.cost, 'audit': b.best.audit || m.best.audit})
    FROM chart b JOIN moves m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1 AND m.p = b.q
    GROUP BY b.conv_id, b.i, m.q
), chosen AS (
    SELECT f.conv_id, min({'cost': b.best.cost + 5 * s.k, 'audit': b.best.audit || repeat('I', s.k)}) AS best
    FROM counted f JOIN chart b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.n JOIN inserted s ON s.p = b.q
    WHERE s.q IN (0, 3) GROUP BY f.conv_id
), letters AS (
    SELECT conv_id, j, best.audit[j] AS letter, length(replace(left(best.audit, j), 'I', '')) AS i,
           (length(replace(left(best.audit, j - 1), 'D', '')) + length(replace(best.audit, 'D', ''))) % 2 = 0 AS even
    FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS j FROM chosen)
), lines AS (
    SELECT l.conv_id, l.j, CASE l.letter WHEN 'K' THEN f.role ELSE if(even, 'user', 'assistant') END || ':'
           || CASE l.letter WHEN 'I' THEN '' ELSE f.text END AS line
    FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE l.letter <> 'D'
), texts AS (
    SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS repaired FROM lines GROUP BY conv_id
)
SELECT a.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank,
       coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
       coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(c.best.cost, 0)::BIGINT AS cost,
       coalesce(c.best.audit, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
