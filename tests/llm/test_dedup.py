"""Exact and near deduplication against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest

from cases import SCHEMA, frame, none, odd, odd_rows, table, words
from plumbline.llm import exact, near
from plumbline.llm.components import components


def test_exact_odd(spark):
    found = table(exact.exact_groups(odd(spark)))
    rows = [(r[0], re.sub("[\x20\x09-\x0d]+", " ", r[1] or "")) for r in odd_rows()]
    want = []
    for d, t in rows:
        ids = [i for i, u in rows if u == t]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((d, keep, len(ids), keep is None or d == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_salts_a_hot_group(spark):
    docs = frame(spark, [(i, "the same text" if i % 3 else f"text {i}") for i in range(300)]).repartition(7)
    found = {r["doc_id"]: r for r in table(exact.exact_groups(docs))}
    assert all(found[i]["keep_id"] == (1 if i % 3 else i) for i in range(300))
    assert found[1]["group_size"] == 200
    assert exact.keep_first(docs).count() == 101


def test_exact_keeps_one_row_of_each_text(spark):
    """Which rows survive: one a text, also of texts whose id is null, shared or that of a copy."""
    normal = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    more = [(None, "null twice"), (None, "null  twice"), (1, "unique under the id of a kept row"), (2, "unique under the id of a copy")]
    for rows in (odd_rows(), odd_rows() + [(d, t, *odd_rows()[0][2:]) for d, t in more]):
        want = {}
        for d, t in [r[:2] for r in rows]:
            old = want.setdefault(normal(t), d)
            want[normal(t)] = min((i for i in (old, d) if i is not None), default=None)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        kept = exact.keep_first(docs)
        assert kept.columns == docs.columns
        found = [(r["doc_id"], normal(r["text"])) for r in table(kept)]
        assert sorted(found, key=repr) == sorted(((d, t) for t, d in want.items()), key=repr)


def brute_components(texts, least=75):
    sets = {}
    for d, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[d] = grams
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= least * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def near_corpus(seed: int, copies: int) -> list[tuple]:
    """A large group of near copies of which some are too far, a common passage, small groups, others."""
    rng = random.Random(seed)
    base, passage = words(rng, 80), words(rng, 25)
    texts = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = "".join(words(rng, 2))
        texts.append(own)
    texts += [[*passage, *words(rng, rng.randint(5, 60))] for _ in range(copies)]
    for _ in range(15):
        first = words(rng, rng.randint(3, 50))
        texts += [first, first[:-1] + ["End"], [w.upper() for w in first]]
    texts += [words(rng, rng.randint(1, 40)) for _ in range(60)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [256, 8])
def test_near_against_all_pairs(spark, monkeypatch, small):
    """With small nodes of 8, the recursion, dense nodes and blocks are all at work."""
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "ASKING", 16)
    monkeypatch.setattr(near, "ASKED", 32)
    texts = near_corpus(small, 90)
    want = brute_components(texts)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in table(near.near_groups(frame(spark, texts).repartition(5)))}
    assert found == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_near_odd(spark):
    found = table(near.near_groups(odd(spark)))
    assert len(found) == len(odd_rows())
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[2]["component_id"] == by[3]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    for empty in (4, 5, 6):
        assert (by[empty]["n_shingles"], by[empty]["component_id"], by[empty]["kept"]) == (0, empty, True)
    assert by[9]["component_id"] == 8 and by[8]["n_shingles"] == 1
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None, None]
    assert all(r["kept"] for r in found if r["doc_id"] in (None, 13))
    assert sorted(c for c in near.keep_one(odd(spark)).columns) == sorted(odd(spark).columns)


def test_rows_of_one_id_are_one_document(spark):
    a, b = " ".join(words(random.Random(1), 20)), " ".join(words(random.Random(2), 20))
    found = table(near.near_groups(frame(spark, [(7, a), (7, b), (8, a), (9, b)])))
    assert {r["component_id"] for r in found} == {7}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200)]
    links += [(rng.randint(300, 330), rng.randint(300, 330)) for _ in range(20)]
    rng.shuffle(links)
    found = {r["id"]: r["component"] for r in table(components(spark.createDataFrame(links, "a long, b long")))}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(30))
    assert 200 not in found
    for a, b in links:
        assert a == b or found[a] == found[b] <= min(a, b)


def test_empty(spark):
    assert exact.exact_groups(none(spark)).count() == 0
    assert near.near_groups(none(spark)).count() == 0
