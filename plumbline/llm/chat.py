"""Conversations as training text: marked turns, escaped contents, a mask of what to learn.

A turn is written as ``<turn>`` role, line break, text ``</turn>`` line break. Inside roles
and texts a backslash becomes two and ``<`` becomes ``\\l``; in roles a line break becomes
``\\n``. So no mark can stand inside a content, and every content is read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import BLOCK_TURNS, in_turn_order

OPEN, BREAK, CLOSE = b"<turn>", b"\n", b"</turn>\n"
ESCAPES = {"\\": "\\", "<": "l", "\n": "n"}  # what follows the backslash
LEARNED = "assistant"
SLICE_BYTES = 8 << 20  # contents assembled in one buffer; a longer turn has its own
PIECE_BYTES = 32 << 20  # a piece this long ends at the next batch of rows
PIECES = "conv_id long, at long, n_turns long, formatted string, loss array<struct<start:int,end:int>>"


def _code_table(characters: str) -> np.ndarray:
    """For each byte the byte that stands for it after a backslash, 0 where none is needed."""
    table = np.zeros(256, np.uint8)
    for c in characters:
        table[ord(c)] = ord(ESCAPES[c])
    return table


TEXT_CODES, ROLE_CODES = _code_table("\\<"), _code_table("\\<\n")


class Contents:
    """The bytes of an Arrow text column, where its values end, and what must be escaped."""

    def __init__(self, values: pa.Array, codes: np.ndarray):
        values = values.cast(pa.large_string())
        _, offsets, data = values.buffers()
        ends = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
        self.data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        self.ends = ends - ends[0]
        self.codes = codes
        self.marked = np.flatnonzero(codes[self.data])
        self.before = np.searchsorted(self.marked, self.ends)  # escapes before each value
        self.lengths = np.diff(self.ends) + np.diff(self.before)

    def scatter(self, out: np.ndarray, starts: np.ndarray) -> None:
        """Copies every value, escaped, to its start in ``out``."""
        shift = starts - self.ends[:-1] - self.before[:-1]
        place = np.arange(len(self.data)) + np.repeat(shift, np.diff(self.ends))
        steps = np.zeros(len(self.data) + 1, np.int64)
        steps[self.marked + 1] = 1
        place += np.cumsum(steps[:-1])
        out[place] = self.data
        at = place[self.marked]
        out[at] = ord("\\")
        out[at + 1] = self.codes[self.data[self.marked]]


def assemble(turns: pa.Table, firsts: np.ndarray) -> pa.RecordBatch:
    """The pieces that begin at the rows ``firsts`` of ``turns``, from one buffer.

    Lengths of all segments give their offsets; headers, roles, texts and ends are
    scattered there.
    """
    n = turns.num_rows
    filled = lambda c: pc.fill_null(turns.column(c).combine_chunks(), "")
    roles, texts = Contents(filled("role"), ROLE_CODES), Contents(filled("text"), TEXT_CODES)
    widths = np.empty((n, 5), np.int64)
    widths[:, 0], widths[:, 2], widths[:, 4] = len(OPEN), len(BREAK), len(CLOSE)
    widths[:, 1], widths[:, 3] = roles.lengths, texts.lengths
    ends = np.concatenate([[0], np.cumsum(widths.ravel())])
    starts = ends[:-1].reshape(n, 5)
    buffer = pa.allocate_buffer(int(ends[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for segment, fixed in ((0, OPEN), (2, BREAK), (4, CLOSE)):
        out[starts[:, segment, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    roles.scatter(out, starts[:, 1])
    texts.scatter(out, starts[:, 3])

    # Code points up to a byte: the bytes before it that do not continue a character.
    continued = np.flatnonzero((out & 0xC0) == 0x80)
    points = lambda at: at - np.searchsorted(continued, at)
    lasts = np.append(firsts[1:], n)
    learned = np.flatnonzero(pc.fill_null(pc.equal(turns.column("role"), LEARNED), False).to_numpy(zero_copy_only=False))
    base = points(starts[firsts, 0])[np.searchsorted(firsts, learned, "right") - 1]
    spans = pa.StructArray.from_arrays(
        [pa.array((points(at[learned]) - base).astype(np.int32)) for at in (starts[:, 3], starts[:, 4])],
        fields=[pa.field("start", pa.int32()), pa.field("end", pa.int32())],
    )
    bounds = np.append(starts[firsts, 0], ends[-1])
    take = lambda c: turns.column(c).combine_chunks().take(pa.array(firsts))
    return pa.RecordBatch.from_arrays(
        [
            take("conv_id"),
            take("at"),
            pa.array(lasts - firsts, pa.int64()),
            pa.StringArray.from_buffers(len(firsts), pa.py_buffer(bounds.astype(np.int32)), buffer),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(learned, np.append(firsts, n)).astype(np.int32)), spans),
        ],
        names=["conv_id", "at", "n_turns", "formatted", "loss"],
    )


def _piece_starts(turns: pa.Table) -> np.ndarray:
    """The rows at which another conversation or another block of turns begins."""
    n = turns.num_rows
    begins = np.zeros(n, bool)
    begins[:1] = True
    for name in ("conv_id", "block"):
        column = turns.column(name).combine_chunks()
        missing = column.is_null().to_numpy(zero_copy_only=False)
        values = column.fill_null(0).to_numpy(zero_copy_only=False)
        begins[1:] |= (values[1:] != values[:-1]) | (missing[1:] != missing[:-1])
    return np.flatnonzero(begins)


def _assembled(turns: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole pieces, at most about ``SLICE_BYTES`` of contents in one buffer."""
    firsts = _piece_starts(turns)
    size = pc.fill_null(pc.binary_length(turns.column("text")), 0).to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(size)])
    part = (upto[firsts] // SLICE_BYTES).tolist()
    cuts = [i for i in range(len(part)) if i == 0 or part[i] != part[i - 1]]
    for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True):
        end = firsts[j] if j < len(part) else turns.num_rows
        yield assemble(turns.slice(firsts[i], end - firsts[i]), firsts[i:j] - firsts[i])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = pa.Table.from_batches([batch])
        turns = fresh if held is None else pa.concat_tables([held, fresh])
        last = int(_piece_starts(turns)[-1])  # its piece may go on in the next batch
        if turns.slice(last).nbytes > PIECE_BYTES:
            last = turns.num_rows
        if last:
            yield from _assembled(turns.slice(0, last))
        held = turns.slice(last) if last < turns.num_rows else None
    if held is not None:
        yield from _assembled(held)


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, n_turns, formatted, loss``: the conversations as text, in pieces.

    A conversation of less than ``BLOCK_TURNS`` turns, all of them numbered from 0 up, is one
    piece. A longer one has a piece for each block of that many turn numbers, and ends
    a piece that grows over ``PIECE_BYTES``; rows without a turn come first, in pieces of
    their own. The pieces of a conversation, by ``at``, are one text. ``loss`` holds the
    code points of ``formatted`` to learn, end exclusive: the texts of assistant turns.
    Rows go by turn, then role and text; repeated rows are turns of their own. A null role
    or text is empty; a null conv_id is a conversation. Other columns are not read. No
    rows give no rows.
    """
    rows = in_turn_order(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    rows = rows.select("conv_id", "at", F.floor(F.col("turn") / BLOCK_TURNS).alias("block"), "role", "text")
    return rows.mapInArrow(_format, PIECES)


def _unescaped(content: str) -> str:
    if "\\" not in content:
        return content
    plain = {code: c for c, code in ESCAPES.items()}
    return re.sub(r"\\(.)", lambda found: plain[found[1]], content)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted piece."""
    *turns, rest = formatted.split(CLOSE.decode())
    if rest:
        raise ValueError("a turn has no end")
    found = []
    for turn in turns:
        if not turn.startswith(OPEN.decode()):
            raise ValueError("a turn has no beginning")
        role, text = turn[len(OPEN) :].split("\n", 1)
        found.append((_unescaped(role), _unescaped(text)))
    return found


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from pieces that come in order; a digest is all that is held."""
    conv = turns = loss = None
    n = learned = chars = 0
    names = [part.split()[0] for part in DIGESTS.split(", ")]

    def row() -> dict:
        return dict(zip(names, (conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars), strict=True))

    schema = pa.schema([(name, pa.string() if name.endswith("sha256") else pa.int64()) for name in names])
    for batch in batches:
        done = []
        columns = (batch[c].to_pylist() for c in ("conv_id", "formatted", "loss"))
        for key, formatted, spans in zip(*columns, strict=True):
            if turns is None or key != conv:
                if turns is not None:
                    done.append(row())
                conv, n, learned, chars = key, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            found = read_turns(formatted)
            n, chars = n + len(found), chars + len(formatted)
            turns.update("".join(f"{role}\n{text}\n" for role, text in found).encode())
            for span in spans:
                text = _unescaped(formatted[span["start"] : span["end"]])
                learned += len(text)
                loss.update(text.encode())
        yield pa.RecordBatch.from_pylist(done, schema)
    if turns is not None:
        yield pa.RecordBatch.from_pylist([row()], schema)


def digests(pieces: DataFrame) -> DataFrame:
    """What the formatted pieces say when read back, one row per conversation.

    A digest over a conversation is a chain over its bytes, so its pieces pass one task in
    order; the task holds a batch and the state of the digest.
    """
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(_digests, DIGESTS)


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose contents look like marks and escapes."""
    saying = "\\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", saying), (-7, 1, LEARNED, saying)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


CHAT_SQL = """
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) r(t)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn>' || replace(replace(replace(role, '\\', '\\\\'), '<', '\\l'), chr(10), '\\n') || chr(10)
                  || replace(replace(text, '\\', '\\\\'), '<', '\\l') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
