"""Sharding, packing and mixing: invariants, brute force and odd inputs."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from cases import frame, none, odd, odd_rows, table
from plumbline.llm import mixing, packing, sharding


def test_shards_are_even_and_gapless(spark):
    docs = frame(spark, [(i, "é" * (i % 5)) for i in range(1003)]).repartition(4)
    found = table(sharding.shard_rows(docs, shards=16))
    counts = Counter(r["shard"] for r in found)
    assert len(found) == 1003 and set(counts.values()) == {62, 63} and set(counts) == set(range(16))
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        text = ("é" * (r["doc_id"] % 5)).encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in table(sharding.shard_rows(docs.repartition(9), shards=16))}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in found}


def plain_allot(counts, nodes, rooms):
    """Row by row: the first node clockwise whose shard has room."""
    rooms, used, out = list(rooms), Counter(), []
    for arc in sorted(counts):
        for rank in range(counts[arc]):
            order = [n for n in nodes if n[0] >= arc] + [n for n in nodes if n[0] < arc]
            shard = next(s for _, s in order if rooms[s])
            out.append((arc, rank, shard, used[shard]))
            rooms[shard] -= 1
            used[shard] += 1
    return out


@pytest.mark.parametrize("balance", [1.0, 1.2])
def test_allotment_against_row_by_row(balance):
    rng = np.random.default_rng(1)
    counts = {int(a): int(rng.integers(1, 9)) for a in rng.choice(64, 40, replace=False)}
    nodes = sharding.ring(5, 4, 64)
    rooms = sharding.capacities(sum(counts.values()), 5, balance)
    found = [
        (arc, rank, shard, slot + rank - first)
        for arc, first, end, shard, slot in sharding.allot(counts, nodes, rooms)
        for rank in range(first, end)
    ]
    assert found == plain_allot(counts, nodes, rooms)


def test_a_new_shard_moves_few_rows():
    nodes = sharding.ring(4, 32, 1024), sharding.ring(5, 32, 1024)
    counts = dict.fromkeys(range(1024), 10)
    placed = []
    for ring, shards in zip(nodes, (4, 5), strict=True):
        home = {}
        for arc, first, end, shard, _ in sharding.allot(counts, ring, sharding.capacities(10240, shards, 1.25)):
            home |= {(arc, rank): shard for rank in range(first, end)}
        placed.append(home)
    moved = sum(placed[0][k] != placed[1][k] for k in placed[0])
    assert moved < 0.5 * len(placed[0])  # a fifth must move, four fifths would by remainders


def padding(ends, lengths):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_boundaries_against_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = rng.integers(0, 30, 25).tolist()
        count = Counter(lengths)
        tops = sorted(count)
        ends = packing.best_boundaries(tops, [count[t] for t in tops], [t * count[t] for t in tops], 3)
        assert len(ends) <= 3 and ends[-1] == max(lengths)
        choices = [(*c, tops[-1]) for k in range(3) for c in combinations(tops[:-1], k)]
        assert padding(ends, lengths) == min(padding(c, lengths) for c in choices)


def test_batches(spark):
    docs = frame(spark, [(i, "w " * (i % 97)) for i in range(900)]).repartition(5)
    found = table(packing.pack(docs, buckets=4, batch_tokens=300))
    assert sorted(r["doc_id"] for r in found) == list(range(900))
    batches = defaultdict(list)
    for r in found:
        assert r["n_tokens"] == r["doc_id"] % 97 <= r["bucket_len"]
        batches[r["bucket"], r["batch"]].append(r)
    last = {b: max(n for c, n in batches if c == b) for b, _ in batches}
    for (bucket, batch), rows in batches.items():
        fits = max(1, 300 // max(1, rows[0]["bucket_len"]))
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert len(rows) == fits or batch == last[bucket] and len(rows) < fits


def test_mix_keeps_to_budget(spark):
    texts = [(i, "w " * (1 + i % 7), "big" if i % 10 else "small", None) for i in range(2000)]
    docs = frame(spark, texts, ", source string, extra string").repartition(3)
    found = table(mixing.mix(docs, max_repetition=3.0))
    size = {i: 1 + i % 7 for i in range(2000)}
    total = {"big": 0, "small": 0}
    for i, _, s, _ in texts:
        total[s] += size[i]
    used = Counter()
    for r in found:
        assert r["n_tokens"] == size[r["doc_id"]]
        used[r["source"]] += r["n_tokens"]
    assert {r["doc_id"] for r in found if r["pass"] == 0} == set(range(2000))
    assert len(found) == len({(r["doc_id"], r["pass"]) for r in found})
    assert used["big"] == total["big"] and used["small"] == 3 * total["small"]
    weights = {r["source"]: r["weight"] for r in found}
    assert weights["small"] == pytest.approx(3 * total["small"] / (3 * total["small"] + total["big"]))
    # In any half of the turns, each source has about half of its tokens.
    half = sum(r["n_tokens"] for r in found if r["source"] == "small" and r["turn"] < 0.5)
    assert half == pytest.approx(used["small"] / 2, rel=0.1)
    assert mixing.repeat(docs, max_repetition=3.0).count() == len(found)


def test_mix_meets_an_entropy(spark):
    docs = frame(spark, [(i, "w", "big" if i % 10 else "small") for i in range(3000)], ", source string")
    shares = spark.createDataFrame([(0.9,), (0.1,)], "q double")
    x = mixing.bisect_exponent(shares, "entropy", 0.5)
    p = np.array([0.9, 0.1]) ** x
    p /= p.sum()
    assert -(p * np.log(p)).sum() == pytest.approx(0.5, abs=1e-6)
    weights = {r["source"]: r["weight"] for r in table(mixing.mix(docs, target_entropy=0.5))}
    assert weights["small"] == pytest.approx(p[1], abs=1e-6)
    assert mixing.bisect_exponent(shares, "entropy", 0.1) == 1.0
    assert mixing.bisect_exponent(shares, "repetition", 100.0) == 0.0


def test_odd(spark):
    n = len(odd_rows())
    assert sharding.shard_rows(odd(spark), shards=4).count() == n
    packed = table(packing.pack(odd(spark)))
    assert len(packed) == n and max(r["bucket_len"] for r in packed) == 30_000
    first = [r for r in table(mixing.mix(odd(spark))) if r["pass"] == 0]
    assert len(first) == n and {r["source"] for r in first} == {"a", None, "", "b"}
    assert mixing.repeat(odd(spark)).columns == odd(spark).columns


def test_empty(spark):
    assert sharding.shard_rows(none(spark)).count() == 0
    assert packing.pack(none(spark)).count() == 0
    assert mixing.mix(none(spark)).count() == 0
    assert mixing.repeat(none(spark)).count() == 0


def test_repeated_documents_lie_apart(spark):
    """Forty documents of three uses among others: uses are no neighbours, and one row fills no part alone."""
    texts = [(i, " ".join(["w"] * (5 + i % 3))) for i in range(400)]
    texts += [t for t in texts[:40] for _ in range(2)] + [(None, "w w w w w")] * 200
    docs = frame(spark, texts).repartition(5)
    together = table(packing.pack(docs, buckets=3, batch_tokens=70))
    apart = table(packing.pack(docs, buckets=3, batch_tokens=70, apart=True))
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["bucket"])
    assert sorted(map(key, apart)) == sorted(map(key, together))
    places = [(r["bucket"], r["batch"], r["slot"]) for r in apart]
    assert len(set(places)) == len(texts)

    def neighbours(rows):
        seen = {}
        for r in rows:
            seen.setdefault((r["doc_id"], r["bucket"], r["batch"]), []).append(r)
        return sum(len(v) > 1 for k, v in seen.items() if k[0] is not None)

    assert neighbours(together) > 30 and neighbours(apart) < 15
    again = table(packing.pack(docs.repartition(2), buckets=3, batch_tokens=70, apart=True))
    place = lambda r: (*key(r), r["batch"], r["slot"])
    assert sorted(map(place, again)) == sorted(map(place, apart))
    assert packing.pack(none(spark), apart=True).count() == 0
