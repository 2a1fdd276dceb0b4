"""Infilling, chat text and repair of conversations, against brute force and exact round trips."""

import hashlib
import itertools
import random
import re
import zlib

import cases
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chat, infill, queries, repair
from plumbline.llm.shared import in_turn_order


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- infilling ------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=300), st.data())
def test_skip_list_reaches_every_rank(lengths, data):
    units = infill.Units(np.array(lengths, np.int64), infill.tower_heights(len(lengths)))
    rank = data.draw(st.integers(0, len(lengths)))
    assert units.chars_before(rank) == sum(lengths[:rank])


def test_skip_list_passes_few_links():
    n = 60_000
    units = infill.Units(np.ones(n, np.int64), infill.tower_heights(n))
    assert len(units.lanes) >= 6
    assert max(len(widths) for widths, _, _ in units.lanes[3:]) < n / 40
    assert [units.chars_before(k) for k in (0, 1, n // 3, n - 1, n)] == [0, 1, n // 3, n - 1, n]


def lines(text):
    parts = text.split("\n")
    found = [part + "\n" for part in parts[:-1]]
    return found + [parts[-1]] if parts[-1] else found


def plain_infill(doc_id, text, fim_rate=100, spm_rate=50):
    text = text or ""
    units = lines(text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def line_texts():
    rng = random.Random(5)
    texts = [(20 + i, "\n" * i) for i in range(4)]
    texts += [(30, "a <M> mark"), (31, "<P"), (32, "S>"), (33, "<S\n>\n<P\n"), (34, "no break"), (35, "é x\r\ny\x85\n😀\n")]
    texts += [(40 + i, "".join(rng.choice("ab\n\n<é😀") for _ in range(rng.randint(1, 400)))) for i in range(60)]
    texts += [(200, "\n".join(str(i) for i in range(50_000)))]
    return texts


@pytest.mark.parametrize("rates", [(100, 50), (30, 100), (0, 50)])
def test_infill_against_plain_cuts(spark, rates):
    rows = [(d, t) for d, t, *_ in cases.odd_rows()] + line_texts()
    docs = cases.odd(spark).select("doc_id", "text", "kept", "n").unionByName(
        cases.frame(spark, line_texts()), allowMissingColumns=True
    )
    made = infill.infill(docs, *rates)
    found = made.select("*", infill.restored().alias("again")).collect()
    key = lambda r: [str(v) for v in r]
    expected = [(d, *plain_infill(d, t, *rates), t or "") for d, t in rows]
    assert sorted((tuple(r) for r in found), key=key) == sorted(expected, key=key)
    assert infill.infill(cases.none(spark)).collect() == []


# ---- chat text ------------------------------------------------------------------

SCHEMA = "conv_id long, turn long, role string, text string, at int, block int, member string, lost_ int"


def odd_turns():
    rng = random.Random(11)
    rows = [
        (1, 0, "system", "Be\nkind."), (1, 1, "user", "a <turn> b </turn>\n c"), (1, 2, "assistant", "\\l \\\\ <\\n> 😀é"),
        (1, 3, "assistant", ""), (2, None, "user", "no turn"), (2, None, None, None), (2, 5, "as\nsist<ant", "role odd"),
        (2, 5, "as\nsist<ant", "role odd"), (2, 5, "assistant", "tie"), (None, 1, "user", "nobody?"),
        (None, None, "assistant", "nobody's"), (3, 0, "", "empty role."), (3, 1, "user", "   \t\n"), (4, 0, "user", None),
        (5, 7, "assistant", "long " * 60_000), (5, -3, "user", "below zero!"), (6, 2**40, "user", "far"), (6, 0, "assistant", "near."),
    ]
    rows += [(9, t, "ua"[t % 2] + "x", f"turn {t % 700}" + ".?! "[rng.randrange(4)]) for t in range(2600)]
    rows += [(10 + i, rng.choice([0, 1, 1, 2, 3, None]), rng.choice(["user", "assistant", "system", "tool", None]),
              rng.choice(["a.", "b", " ", "", None, "c!\n"])) for i in range(60) for _ in range(rng.randint(1, 7))]
    return rows


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "m", 3) for r in rows], SCHEMA).repartition(5)


def ordered(rows):
    """Rows of each conversation in order; nulls first, ties by role and text."""
    first = lambda v: (v is not None, "" if v is None else v)
    turn = lambda r: (r[1] is not None, r[1] or 0)
    by = {}
    for r in sorted(rows, key=lambda r: (turn(r), *((first(r[2]), first(r[3]))))):
        by.setdefault(r[0], []).append(r)
    return by


def test_order_of_turns(spark):
    got = {}
    for r in in_turn_order(turns_frame(spark, odd_turns()).drop("at")).orderBy("at").collect():
        got.setdefault(r["conv_id"], []).append((r["conv_id"], r["turn"], r["role"], r["text"]))
    assert got == ordered(odd_turns())


def test_chat_is_read_back_exactly(spark):
    pieces = chat.format_turns(turns_frame(spark, odd_turns())).orderBy("at").collect()
    got, learned, n = {}, {}, {}
    for p in pieces:
        got.setdefault(p["conv_id"], []).extend(chat.read_turns(p["formatted"]))
        assert p["n_turns"] == len(chat.read_turns(p["formatted"]))
        n[p["conv_id"]] = n.get(p["conv_id"], 0) + 1
        for s in p["loss"]:
            learned.setdefault(p["conv_id"], []).append(chat._unescaped(p["formatted"][s["start"] : s["end"]]))
            assert p["formatted"][: s["start"]].endswith("<turn>assistant\n")
            assert p["formatted"][s["end"] :].startswith("</turn>\n")
    expected = {c: [(r[2] or "", r[3] or "") for r in rows] for c, rows in ordered(odd_turns()).items()}
    assert got == expected
    assert learned == {c: ts for c, rows in expected.items() if (ts := [t for role, t in rows if role == "assistant"])}
    assert n[9] == 3 and n[1] == 1  # a piece for each 1024 turns
    assert chat.format_turns(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pieces_end_where_buffers_do(spark, monkeypatch):
    """Small batches and buffers: pieces go on over batches, long ones end."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} é<{t}" * 40) for c in range(5) for t in range(70)]
    table = pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows])
    table = table.append_column("at", pa.array(range(len(rows)))).append_column("block", pa.array([0] * len(rows)))
    monkeypatch.setattr(chat, "SLICE_BYTES", 3000)
    for limit in (1 << 30, 9000):
        monkeypatch.setattr(chat, "PIECE_BYTES", limit)
        made = [p for b in chat._format(iter(table.to_batches(max_chunksize=13))) for p in b.to_pylist()]
        got = [(p["conv_id"], *turn) for p in made for turn in chat.read_turns(p["formatted"])]
        assert got == [(c, role, text) for c, _, role, text in rows]
        assert (len(made) == 5) == (limit > 9000)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.execute(f"CREATE TABLE {name} (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", rows)
    found = con.sql(sql)
    return [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]


def same(df, expected):
    key = lambda r: [str(r[k]) for k in sorted(r)]
    assert sorted((r.asDict() for r in df.collect()), key=key) == sorted(expected, key=key)


def test_chat_digests_as_in_sql(spark):
    rows = odd_turns()
    made = chat.digests(chat.format_turns(chat.with_probe(turns_frame(spark, rows))))
    same(made, duck(chat.CHAT_SQL, conversations=rows))


# ---- repair ---------------------------------------------------------------------


def full_chart(codes):
    """The whole triangular chart, every split of every span tried."""
    n = len(codes)
    chart = {(i, i + 1): repair.row_cell(c) for i, c in enumerate(codes)}
    for width in range(2, n + 1):
        for i in range(n - width + 1):
            made = [repair.join(chart[i, k], chart[k, i + width]) for k in range(i + 1, i + width)]
            chart[i, i + width] = tuple(min((m[x] for m in made if m[x] is not None), default=None) for x in range(16))
    return repair.best(chart[0, n]) if n else repair.best(repair.EMPTY)


def all_edits(codes, most_inserts=3):
    """Every sequence of edits with few insertions, one by one."""
    best = None
    gaps = [k for k in itertools.product(range(most_inserts + 1), repeat=len(codes) + 1) if sum(k) <= most_inserts]
    options = []
    for c in codes:
        bits = int(c, 16)
        row = [(2, "D", "")]
        if not bits & 4:
            extra = 5 * (bits >> 3)
            row += [(extra, "K", "xuas"[bits & 3]), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        options.append(row)
    for ks in gaps:
        for fill in itertools.product("ua", repeat=sum(ks)):
            for rows in itertools.product(*options):
                it, audit, roles, cost = iter(fill), "", "", 0
                for k, row in itertools.zip_longest(ks, rows):
                    for _ in range(k):
                        audit, roles, cost = audit + "I", roles + next(it), cost + 5
                    if row:
                        audit, roles, cost = audit + row[1], roles + row[2], cost + row[0]
                if re.fullmatch("(s?(ua)+)?", roles):
                    best = min(best or (cost, audit), (cost, audit))
    return best


def test_cells_against_all_splits_and_all_edits():
    rng = random.Random(2)
    digits = "0123" * 3 + "5678" + "9ab4"
    for n in [0, 1, 2, 3] * 6 + [7, 15, 17, 33, 40]:
        codes = "".join(rng.choice(digits) for _ in range(n))
        found = repair.best(repair.span_cell(codes))
        assert found == full_chart(codes)
        if n <= 3:
            assert found == all_edits(codes)


def plain_damage(rows):
    made = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
        made += [] if how == 0 else [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return made


def plain_report(conv, rows):
    space = " \t\n\v\f\r"
    seen, codes, counts, initials = set(), "", [0, 0, 0], []
    for _, _, role, text in rows:
        body = text.rstrip(space)
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        initials.append(role[:1])
        if fault is not None:
            counts[fault] += 1
        codes += "%x" % (max(0, "uas".find(role[:1] or "x") + 1) + (4 if fault in (0, 1) else 8 if fault == 2 else 0))
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit = repair.best(repair.Spans(map(repair.row_cell, codes)).cell())
    out, at = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at][2:]
        at += letter != "I"
        if letter != "D":
            out.append((role if letter == "K" else None, text if letter != "I" else ""))
    odd = len(out) % 2
    out = [(role if role is not None else ("user", "assistant")[(i - odd) % 2], text) for i, (role, text) in enumerate(out)]
    return dict(
        conv_id=conv, gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank=counts[0],
        duplicate=counts[1], truncated=counts[2],
        illegal=sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        cost=cost, audit=audit, repaired_sha256=sha("\n".join(f"{r}:{t}" for r, t in out)),
    )


def test_repair_against_plain_rows(spark):
    rows = odd_turns()
    by = ordered(plain_damage(rows))
    expected = [plain_report(c, by.get(c, [])) for c in {r[0] for r in rows}]
    repaired = repair.repair(repair.damaged(turns_frame(spark, rows)))
    same(repair.digests(repaired), expected)
    turns = {}
    for r in repaired.turns.orderBy("at", "part").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"] or " ")[0])
    for initials in turns.values():
        legal = "".join(initials).removeprefix("s")
        assert legal and legal == "ua" * (len(legal) // 2)
    numbered = [r for r in rows if r[0] != 9]
    sql = duck(repair.REPAIR_SQL, conversations=numbered)
    assert sorted(map(str, sql)) == sorted(map(str, (e for e in expected if e["conv_id"] != 9)))


def test_repair_without_damage_and_without_rows(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "assistant", "ho."), (2, 0, "user", "cut"), (3, 0, None, None)]
    found = {r["conv_id"]: r for r in repair.repair(turns_frame(spark, rows)).report.collect()}
    assert (found[1]["cost"], found[1]["audit"]) == (0, "KK")
    assert (found[2]["cost"], found[2]["audit"], found[2]["truncated"]) == (2, "D", 1)
    assert (found[3]["cost"], found[3]["audit"], found[3]["blank"]) == (2, "D", 1)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = repair.repair(repair.damaged(none))
    assert made.report.collect() == [] and made.turns.collect() == [] and repair.digests(made).collect() == []


def test_registered_with_sql():
    for name in ("op11_infilling", "op12_chat_format", "op13_structure_repair"):
        assert name in queries.QUERIES and name in queries.ORACLES
