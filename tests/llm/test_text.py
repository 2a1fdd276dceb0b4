"""Fingerprints, licences, languages, personal data, scores: brute force, accuracy, odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import SF_DIR, frame, none, odd, odd_rows, table, words

from plumbline.llm import language, licenses, pii, pseudo, syncmers
from plumbline.llm.shared import words_of


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chained(values):
    """Spark's xxhash64 of several values: each hash seeds the next."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else signed(v % 2**64).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def brute_anchors(text, k=syncmers.K, s=syncmers.S):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    if not ws:
        return []
    if len(ws) < k:
        return [(signed(chained(ws)), 0)]
    inner = [signed(chained(ws[i : i + s])) for i in range(len(ws) - s + 1)]
    out = []
    for i in range(len(ws) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            out.append((signed(chained(window[::s])), i))
    return out


def brute_likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def in_hex(anchors):
    return "".join(f"{h % 2**64:016x}" for h, _ in anchors)


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(8)
    texts = [(i * 3, " ".join(words(rng, rng.randint(0, 120)))) for i in range(90)]
    texts += [(500, "É" * 9 + " tail"), (501, None), (502, "a b"), (503, " ".join(words(rng, 4000)))]
    found = {r["doc_id"]: r for r in table(syncmers.fingerprints(frame(spark, texts).repartition(6)))}
    assert len(found) == len(texts)
    for (d, t), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        t, following = t or "", following or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r, own, changed = found[d], all_anchors(t), all_anchors(edited)
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == in_hex(own)
        assert r["edited_fingerprint"] == in_hex(changed)
        assert r["near_edited"] == pytest.approx(brute_likeness(own, changed))
        assert r["near_next"] == pytest.approx(brute_likeness(own, all_anchors(following)))


def test_positions_match(spark):
    rng = random.Random(2)
    shared, a, b = words(rng, 30), words(rng, 11), words(rng, 17)
    rows = spark.createDataFrame([(" ".join(a + shared), " ".join(b + shared))], "x string, y string")
    rows = syncmers.with_anchors(syncmers.with_anchors(rows, "x", "p"), "y", "q")
    found = rows.select(syncmers.matches("p", "q").alias("m")).first()["m"]
    assert found and all(m["there"] - m["here"] == 6 for m in found if m["here"] >= 11)


def all_anchors(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    return brute_anchors(text) or ([(signed(chained(ws)), 0)] if ws else [])


def test_all_anchors_and_exact_likeness(spark):
    """Long texts keep every anchor with its place; a passage of 40 in 3,000 words is seen."""
    rng = random.Random(5)
    passage = words(rng, 40)
    long = [words(rng, 1500) + passage + words(rng, 1500), words(rng, 900) + passage + passage + words(rng, 2000)]
    texts = [(i, " ".join(t)) for i, t in enumerate(long)] + [(2, None), (3, " ".join(words(rng, 30)))]
    found = {r["doc_id"]: r for r in table(syncmers.fingerprints(frame(spark, texts).repartition(3)))}
    for (d, t), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own, changed, other = all_anchors(t), all_anchors(edited), all_anchors(following)
        assert [tuple(a) for a in found[d]["anchors"]] == own
        assert [tuple(a) for a in found[d]["edited_anchors"]] == changed
        for name, b in (("near_edited", changed), ("near_next", other)):
            assert found[d][name] == pytest.approx(brute_likeness(own, b))
    assert len(found[0]["anchors"]) > 1000 and 0 < found[0]["near_next"] < 0.02


def test_only_texts_without_words_have_no_anchor(spark):
    rng = random.Random(7)
    texts = [(i, " ".join(words(rng, 6 + i % 3))) for i in range(60)]
    assert sum(not brute_anchors(t) for _, t in texts) > 5
    texts += [(100, None), (101, ""), (102, " \t\n")]
    found = {r["doc_id"]: r for r in table(syncmers.fingerprints(frame(spark, texts)))}
    for d, t in texts:
        assert [tuple(a) for a in found[d]["anchors"]] == all_anchors(t)
        assert bool(found[d]["anchors"]) == bool((t or "").split())
    assert all(found[i]["near_next"] == 0 for i in range(60))
    assert found[100]["near_next"] == 1 and found[102]["near_next"] == 0


def test_matches_pair_all_repeats(spark):
    rng = random.Random(6)
    passage = words(rng, 30)
    x, y = passage + words(rng, 5) + passage, words(rng, 7) + passage + passage
    rows = spark.createDataFrame([(" ".join(x), " ".join(y))], "x string, y string")
    rows = syncmers.with_anchors(syncmers.with_anchors(rows, "x", "p"), "y", "q")
    found = [tuple(m) for m in rows.select(syncmers.matches("p", "q").alias("m")).first()["m"]]
    assert found == [(i, j, h) for h, i in all_anchors(" ".join(x)) for g, j in all_anchors(" ".join(y)) if g == h]
    assert {j - i for i, j, _ in found} >= {7, 37, -28, 2}


def test_licences(spark):
    files = [
        (1, "pkg/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "pkg/src/a.py", "code here"),
        (3, "pkg/src/deep/b.py", "Released under the MIT License.\nmore of the text"),
        (4, "pkg/src/deep/c.py", None),
        (5, "other/d.py", "nothing about the license of it all"),
        (6, "pkg/src/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (7, "top.txt", ""),
        (8, None, "All rights reserved."),
    ]
    found = {r["doc_id"]: r for r in table(licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")))}
    assert (found[1]["license"], found[1]["via"]) == ("Apache-2.0", "header")
    assert (found[2]["license"], found[2]["license_path"]) == ("GPL-3.0", "pkg/src/COPYING")
    assert (found[3]["license"], found[3]["own_score"]) == ("MIT", 1.0)
    assert (found[4]["license"], found[4]["via"]) == ("MIT", "inherited")  # b.py is mostly its notice
    assert (found[5]["license"], found[5]["via"], found[5]["license_path"]) == ("Proprietary", "inherited", "")
    assert found[7]["license"] == "Proprietary" and found[8]["via"] == "header"


def test_licences_in_other_words_wrapped_and_whole(spark):
    common = [(100 + i, f"a/{i}.txt", "it was what it was and so it goes on") for i in range(60)]
    permission = next(text for name, text in licenses.TEMPLATES if name == "MIT" and len(text) > 100)
    words = permission.split()
    wrapped = "\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8))
    files = [
        (1, "b/1.py", "It was released under the MIT License."),
        (2, "c/2.py", "code first\n# This Source Code Form is subject to the\n# terms of the Mozilla Public License, v. 2.0.\nmore"),
        (3, "d/3.py", f"some heading here\n\n{wrapped}\n\nand a long tail of other text follows " + "more words " * 40),
        (4, "e/COPYING", f"Copyright 2001 Somebody\n{wrapped}"),
        (5, "e/5.py", "nothing"),
        (6, "f/6.py", "a license to kill was never released under the table by anybody at all"),
        *common,
    ]
    found = {r["doc_id"]: r for r in table(licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")))}
    assert {i: found[i]["own_license"] for i in range(1, 7)} == {1: "MIT", 2: "MPL-2.0", 3: "MIT", 4: "MIT", 5: None, 6: None}
    assert found[3]["own_score"] == 1.0 and found[2]["own_score"] == 1.0
    assert (found[5]["via"], found[5]["license_path"]) == ("inherited", "e/COPYING")
    assert all(found[i]["license"] is None for i, _, _ in common)


def test_units_that_cannot_reach_are_below_the_cosine(spark):
    rng = random.Random(8)
    idf = {"a": 1.5, "b": 3.0, "c": 1.0}
    texts = [" ".join(rng.choices("abcxyzw", k=rng.randint(1, 9))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.split("t", " ").alias("w"))
    shares = [{"a": 0.6, "b": 0.8}, {"c": 1.0}]
    kept = {r["t"] for r in rows.filter(licenses.could_reach(F.col("w"), idf, shares, 0.7)).collect()}
    assert 0 < len(kept) < len(set(texts))
    for text in set(texts):
        weight = {w: text.split().count(w) * idf.get(w, 1.0) for w in set(text.split())}
        others = sum(text.split().count(w) for w in set(text.split()) - set(idf))
        norm = np.sqrt(sum(weight.get(w, 0) ** 2 for w in idf) + others)
        best = max(sum(weight.get(w, 0) * x for w, x in v.items()) for v in shares)
        assert (best >= 0.7 * norm) == (text in kept)
        assert best < 0.7 * np.sqrt(sum(x * x for x in weight.values())) or text in kept


def test_anchors_lose_no_line():
    rng = np.random.default_rng(3)
    names = [f"t{i}" for i in range(12)]
    weights = {f"l{k}": {n: float(rng.uniform(0.5, 5)) for n in rng.choice(names, 6, replace=False)} for k in range(4)}
    needed = set(licenses.anchors(weights, 0.7))
    for _ in range(2000):
        line = {n: float(rng.uniform(0.5, 5)) for n in rng.choice(names, rng.integers(1, 9), replace=False)}
        for vector in weights.values():
            dot = sum(w * vector.get(n, 0) for n, w in line.items())
            cosine = dot / np.sqrt(sum(w * w for w in line.values()) * sum(w * w for w in vector.values()))
            assert cosine < 0.7 or needed & set(line)


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()
    # Neither the label nor the source of a held-out document can matter.
    blind = docs.withColumns({"source": docs["lang"], "lang": docs["lang"].substr(1, 0)})
    model = language.learn(docs)
    assert {model.predict(language.profile("the and of to in"))[0]} <= set(model.languages)
    assert language.learn(blind).languages == [""]


def test_language_profile():
    assert language.profile("123 !?") is None and language.profile("") is None and language.profile(None) is None
    long = "word and word " * 200_000
    assert np.allclose(language.profile(long), language.profile("word and word " * 100_000), atol=1e-2)
    assert np.allclose(language.profile("Ab,  c"), language.profile("aB c"))


def test_families():
    centres = np.eye(4) + np.array([[0, 0.9, 0, 0], [0.9, 0, 0, 0], [0, 0, 0, 0.8], [0, 0, 0.8, 0]])
    assert sorted(language.families(centres)) == [[0, 1], [2, 3]]


def naive_base(text):
    """The patterns as they are written, without shortcuts."""
    found = [(1, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((2, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((3, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((4, *m.span()))
    return found


def test_base_spans_against_the_patterns():
    rng = random.Random(6)
    pieces = ["a", "b.c", "@", ".", "12", "1.2.3.4", "256.1.1.1", "+1 (743) 555-3824", "+", "4111 1111 1111 1111", "-", " ", "x@y.z", "é", "4" * 16, "000.0.0.00", "%", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert pii.base_spans(text) == naive_base(text), text


def test_long_texts_are_searched_quickly():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@a" * 100_000, "+1 " * 100_000, "a@" * 50_000 + "b.c"):
        pii.base_spans(text)


def test_the_field_completes_repeated_tokens():
    rng = random.Random(7)
    texts = []
    for _ in range(300):
        number = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        texts.append(" ".join([*words(rng, 5), number, *words(rng, 4), f"{rng.randint(1, 99)}", *words(rng, 3)]))
    field = pii.fit(Counter(e for text in texts for e in pii.examples(text)))
    assert pii.added_spans(field, texts[0], pii.base_spans(texts[0])) == []
    tokens = pii.tokens_of(texts[0])
    assert tokens.chain and np.allclose(pii.marginals(field, tokens).sum(axis=1), 1)
    twice = pii.tokens_of("5551234 and 5551234")
    assert twice.skip == [(0, 1)]
    # What one token is sure of reaches its repetition through the skip edge.
    lone = np.zeros_like(field.unary)
    for f in set(twice.features[0]) - set(twice.features[1]):
        lone[f, 4] = 6
    linked = pii.Field(lone, np.zeros((5, 5)), np.eye(5) * 3)
    apart = pii.Field(lone, np.zeros((5, 5)), np.zeros((5, 5)))
    assert pii.marginals(linked, twice)[1, 4] > pii.marginals(apart, twice)[1, 4] + 0.3


def test_message_passing_is_exact_on_a_chain():
    """On a tree, sum-product gives the true marginals."""
    rng = np.random.default_rng(9)
    n = len(pii.KINDS) + 1
    field = pii.Field(rng.normal(size=(pii.WIDTH, n)), rng.normal(size=(n, n)), np.zeros((n, n)))
    tokens = pii.Tokens([(0, 1)] * 3, [[1, 2], [3], [4, 5]], [0, 1], [])
    scores = np.stack([field.unary[f].sum(axis=0) for f in tokens.features])
    joint = np.exp(scores[0][:, None, None] + scores[1][None, :, None] + scores[2][None, None, :] + field.chain[:, :, None] + field.chain[None])
    joint /= joint.sum()
    want = [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]
    assert np.allclose(pii.marginals(field, tokens), want, atol=1e-2)


def test_the_field_learns_counts_of_all_examples(spark):
    """Counted in tasks, in any number of them, the examples give the field of the texts themselves."""
    rng = random.Random(10)
    rows = [(i, " ".join([*words(rng, 4), f"+1 ({i % 7}12) 555-{1000 + i}", "a@b.org", str(i % 5)])) for i in range(60)]
    want = pii.fit(Counter(e for _, text in rows for e in pii.examples(text)))
    docs = spark.createDataFrame([*rows, (None, None), (61, ""), (62, "no sign")], "doc_id long, text string")
    for parts in (1, 5):
        found = pii.learn(docs.repartition(parts))
        assert all(np.array_equal(getattr(found, name), getattr(want, name)) for name in ("unary", "chain", "skip"))
    assert not pii.learn(docs.limit(0)).unary.any()


def test_personal_data(spark):
    found = {r["doc_id"]: r for r in table(pii.find(odd(spark)))}
    assert found[14]["spans"].split(",")[:3] == ["email:13:28", "ip:30:38", "ip:40:48"]
    assert (found[14]["n_email"], found[14]["n_ip"]) == (1, 2)
    assert found[4]["spans"] == "" and found[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_scores_against_one_token_at_a_time(spark):
    texts = [(1, "a b a b a c"), (2, "a"), (3, None), (4, "b b b unseen words here"), (5, "a b a b")]
    docs = frame(spark, texts)
    vocabulary = pseudo.vocabulary(docs)
    flat = pseudo.train(docs, vocabulary)
    found = {r["doc_id"]: r for r in table(pseudo.score(docs))}
    e, top, low = pseudo.parts(flat.astype(np.float64), vocabulary.size)
    share = lambda s, own: s[own] - np.log(np.exp(s).sum())
    for d, t in texts:
        ids = vocabulary.ids(t).tolist()
        total = 0.0
        for i, own in enumerate(ids):
            h = np.zeros(pseudo.HIDDEN)
            for k, o in enumerate(pseudo.OFFSETS):
                h += e[k][ids[i + o] if 0 <= i + o < len(ids) else vocabulary.size - 1]
            g, m = divmod(own, pseudo.groups(vocabulary.size)[1])
            h = np.append(np.tanh(h), 1)
            total += share(h @ top, g) + share(h @ low[g], m)
            total += vocabulary.within[own]
        assert found[d]["n_tokens"] == len(ids)
        assert found[d]["log_prob"] == pytest.approx(total, abs=1e-2)
    assert found[3]["mean_log_prob"] is None


def test_words_count_within_their_class(spark, monkeypatch):
    """A word of a class of several has its own share of the class, whether its count is cached or joined."""
    rng = random.Random(11)
    many = sorted(set(words(rng, 900)))
    monkeypatch.setattr(pseudo, "CLASSES", 256)
    texts = [(i, " ".join(rng.choices(many, [1 / (j + 1) for j in range(len(many))], k=150))) for i in range(40)]
    texts += [(100 + i, texts[0][1]) for i in range(5)] + [(None, texts[0][1]), (200, None)]
    docs = frame(spark, texts).repartition(4)
    n = Counter(w for _, text in texts for w in (text or "").encode().split())
    for cached in (0, 250, 50_000):
        monkeypatch.setattr(pseudo, "CACHED", cached)
        vocabulary = pseudo.vocabulary(docs)
        of = {w: int(vocabulary.ids(w.decode())[0]) for w in n}
        assert vocabulary.size == 256 and max(Counter(of.values()).values()) > 1
        total = Counter()
        for w, c in of.items():
            total[c] += n[w]
        weights = pseudo.initial(vocabulary)
        found = {r["doc_id"]: r["log_prob"] for r in table(pseudo.score(docs, rounds=0))}
        for d, text in texts:
            ids, at, _ = pseudo._joined(vocabulary.size, [vocabulary.ids(text)])
            plain = pseudo.log_probabilities(vocabulary, weights, ids, at) - vocabulary.within[ids[at]]
            share = sum(np.log(n[w] / total[of[w]]) for w in (text or "").encode().split())
            assert found[d] == pytest.approx(plain.sum() + share, abs=1e-6)


def test_classes_grow_with_the_words(spark, monkeypatch):
    monkeypatch.setattr(pseudo, "CLASSES", 256)
    docs = frame(spark, [(i, " ".join(f"w{j}" for j in range(i * 30_000, i * 30_000 + 30_000))) for i in range(3)])
    vocabulary = pseudo.vocabulary(docs)
    assert vocabulary.size == 1200 and len(vocabulary.classes) >= 900
    assert len(pseudo.initial(vocabulary)) == sum(int(np.prod(s)) for s in pseudo.sizes(1200))


@pytest.mark.parametrize("classes", [2, 3, 16, 17, 300, 1024])
def test_probabilities_of_all_classes_add_to_one(classes):
    g, m = pseudo.groups(classes)
    assert g * m >= classes and (g - 1) * m < classes
    rng = np.random.default_rng(4)
    flat = rng.normal(0, 0.5, sum(int(np.prod(s)) for s in pseudo.sizes(classes)))
    weights = pseudo.parts(flat, classes)
    ids = np.concatenate([[1, 0], np.arange(classes), [0, 1]])
    total = 0.0
    for c in range(g * m):
        ids[2] = c % classes
        h = pseudo.hidden(weights, np.where(np.arange(len(ids)) == 2, 0, ids), np.array([2]))
        top, low = h.T @ weights[1], h.T @ weights[2][c // m]
        share = lambda s, own: np.exp(s[0, own]) / np.exp(s).sum()
        total += share(top, c // m) * share(low, c % m)
        if c < classes:
            logs = pseudo._log_probabilities(weights, classes, np.zeros(classes), ids, np.array([2]))
            h = pseudo.hidden(weights, ids, np.array([2]))
            top, low = h.T @ weights[1], h.T @ weights[2][c // m]
            assert logs[0] == pytest.approx(np.log(share(top, c // m) * share(low, c % m)))
    assert total == pytest.approx(1)


def test_partitions_do_not_matter(spark):
    """Shards are dealt by a hash, so the same documents give the same weights from 2 and from 7 partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("doc_id < 80")
    a, b = ({r["doc_id"]: r["log_prob"] for r in table(pseudo.score(docs.repartition(n)))} for n in (2, 7))
    assert a == pytest.approx(b, rel=1e-6)
    assert pseudo.shards_of(0) == (1, 256) and pseudo.shards_of(10**9) == (250, 4096)


def test_every_token_is_a_target_once():
    for rounds in (1, 2, 3):
        for n in (0, 1, 2, 25):
            found = np.concatenate([pseudo.targets(np.arange(2, 2 + n), turn, rounds) for turn in range(rounds)])
            assert sorted(found) == list(range(2, 2 + n))


def test_gradient():
    rng = np.random.default_rng(1)
    classes = 50
    size = sum(int(np.prod(s)) for s in pseudo.sizes(classes))
    flat = rng.normal(0, 0.3, size)
    ids, at = rng.integers(0, classes, 40), np.arange(2, 38)

    def loss(w):
        return -pseudo._log_probabilities(pseudo.parts(w, classes), classes, np.zeros(classes), ids, at).mean()

    squares = np.zeros(size)
    before = flat.copy()
    with np.errstate(invalid="ignore"):
        pseudo.train_step(flat, squares, ids, at, classes)
    gradient = np.sqrt(squares) * np.sign(before - flat)
    for i in rng.choice(np.flatnonzero(squares > 1e-10), 60, replace=False):
        step = np.zeros(size)
        step[i] = 1e-5
        assert gradient[i] == pytest.approx((loss(before + step) - loss(before - step)) / 2e-5, rel=1e-3, abs=1e-8)


def test_words_of_many_texts_are_those_of_each():
    texts = ["A b\x0bC\x0c d\r\n", None, "", " \t", "\x1cÄ b\x85c\u00a0D\u3000e\x00F ", "".join(map(chr, range(1, 768))), "İK x"]
    found, n = pseudo._split(pa.array(["left out", *texts]).slice(1))
    assert n.tolist() == [len(words_of(t)) for t in texts]
    assert found.to_pylist() == [w for t in texts for w in words_of(t)]


def test_words_are_counted_over_all_pieces(monkeypatch):
    """Counts are merged and handed on in parts; no word is lost, and a word's parts add up."""
    texts = [" ".join(f"W{i % 7} w{i * j}" for j in range(40)) for i in range(60)] + [None, ""]
    whole = Counter(w for t in texts for w in words_of(t))
    for counted in (3, 200, 10**6):
        monkeypatch.setattr(pseudo, "COUNTED", counted)
        batches = (pa.record_batch({"text": pa.array(texts[i : i + 9], pa.string())}) for i in range(0, len(texts), 9))
        total = Counter()
        for part in pseudo._counted(batches):
            for r in part.to_pylist():
                assert r["hash"] == xxhash.xxh32_intdigest(r["word"])
                total[r["word"]] += r["n"]
        assert total == whole


def test_every_token_is_weighed_once():
    """Groups of any sizes, alone in pieces or with others of about their size: every token counts once, in its group."""
    rng = np.random.default_rng(5)
    for held in ([1], [3000], rng.integers(0, 90, 40), [5000, 1, 1, 48, 49, 47, 2, 0, 1024]):
        group = np.repeat(np.arange(len(held)), held)
        seen = []
        for some, here, _, counts in pseudo._spans(group):
            if counts is None:
                places = np.arange(len(group))[here]
                assert (group[places] == some).all()
            else:
                places = here[counts]
                assert (group[places] == np.broadcast_to(some[:, None], here.shape)[counts]).all()
            seen += places.tolist()
        assert sorted(seen) == list(range(len(group)))


@pytest.mark.parametrize("scale", [0.3, 40])
def test_products_of_several_groups(scale):
    """Gradients and log shares of groups weighed together are those of one token after another, for large scores too."""
    rng = np.random.default_rng(6)
    weights = rng.normal(0, scale, (3, pseudo.HIDDEN + 1, 5)).astype(np.float32)
    large = pseudo._large(weights)
    assert large == (scale > 1)
    h = np.ones((3, 4, pseudo.HIDDEN + 1), np.float32)
    h[..., :-1] = np.tanh(rng.normal(0, 1, (3, 4, pseudo.HIDDEN)))
    member, counts = rng.integers(0, 5, (3, 4)), rng.integers(0, 2, (3, 4)).astype(bool)
    chosen = (np.arange(3)[:, None], np.arange(4), member)
    logs = pseudo._log_share(weights, h, chosen, large)
    inner, change = pseudo._error(weights, h, chosen, large, counts)
    expected = np.zeros(weights.shape)
    for g, t in np.ndindex(3, 4):
        scores = h[g, t].astype(float) @ weights[g].astype(float)
        share = np.exp(scores - scores.max())
        share /= share.sum()
        assert logs[g, t] == pytest.approx(scores[member[g, t]] - scores.max() - np.log(np.exp(scores - scores.max()).sum()), rel=1e-4, abs=1e-4)
        error = (share - np.eye(5)[member[g, t]]) * counts[g, t]
        assert inner[g, t] == pytest.approx(weights[g, :-1].astype(float) @ error, rel=1e-3, abs=1e-3)
        expected[g] += np.outer(h[g, t], error)
    assert change == pytest.approx(expected, rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("scale", [0.3, 40])
def test_runs_of_groups_are_weighed_as_each_alone(scale):
    """Runs of several groups in one piece give the errors and log shares of each group by itself."""
    rng = np.random.default_rng(12)
    own = rng.choice(300, 2500, p=(1 / np.arange(1, 301)) / (1 / np.arange(1, 301)).sum())
    order, group, member = pseudo._by_group(own, 300)
    assert (group * pseudo.groups(300)[1] + member == own[order]).all()
    weights = [None, rng.normal(0, scale, (pseudo.HIDDEN + 1, 18)), rng.normal(0, scale, (18, pseudo.HIDDEN + 1, 17))]
    weights[0] = weights[1]
    h = np.ones((2500, pseudo.HIDDEN + 1))
    h[:, :-1] = np.tanh(rng.normal(0, 1, (2500, pseudo.HIDDEN)))
    room, low, large = pseudo._room(weights), weights[2], pseudo._large(weights[2])
    inner, change = np.zeros((2500, pseudo.HIDDEN)), np.zeros_like(low)
    wanted, change_wanted, seen, several = np.zeros_like(inner), np.zeros_like(low), [], False
    for some, here, _, counts in pseudo._pieces(group):
        if counts is not None:
            seen += here[counts].tolist()
            continue
        several = several or len(some) > 1
        assert some[-1][1].stop - some[0][1].start <= pseudo.BLOCK
        pseudo._add_errors(low, h, some, member, large, room, inner, change, 0.5)
        logs = [pseudo._log_share(low[g], h[at], (np.arange(at.stop - at.start), member[at]), large) for g, at in some]
        assert pseudo._log_shares(low, h, some, member, large, room) == pytest.approx(np.concatenate(logs))
        for g, at in some:
            assert (group[at] == g).all()
            seen += range(at.start, at.stop)
            error, c = pseudo._error(low[g], h[at], (np.arange(at.stop - at.start), member[at]), large)
            wanted[at] += error / 2
            change_wanted[g] += c / 2
    assert several and sorted(seen) == list(range(2500))
    assert inner == pytest.approx(wanted) and change == pytest.approx(change_wanted)


@pytest.mark.parametrize("classes", [1, 40, 70_000])
@pytest.mark.parametrize("n", [1, 7, 9, 3000, 9000])
def test_rows_are_summed_by_class_and_offset(n, classes):
    """Classes seen once, a few times or often, at each offset, have the sums of all their rows."""
    rng = np.random.default_rng(n)
    rows, near = rng.normal(size=(n, 3)), [rng.zipf(1.4, n) % classes for _ in pseudo.OFFSETS]
    wanted = np.zeros((len(near) * classes, 3))
    for k, c in enumerate(near):
        np.add.at(wanted, c + k * classes, rows)
    seen, total = pseudo._sums(rows, near, classes)
    assert sorted(seen) == sorted({int(i) + k * classes for k, c in enumerate(near) for i in c})
    assert total == pytest.approx(wanted[seen])


def test_uses_of_rare_words_are_not_sorted(spark):
    """The counts of words that are not cached are hashed for the join; the uses are not sorted."""
    docs = frame(spark, [(i, f"a b c{i} d{i % 3} é\u00a0{i % 2}") for i in range(12)] + [(None, None), (50, "")])
    counts = pseudo.counted(docs)
    vocabulary = pseudo.Vocabulary(16, [(b"a", 12)], {12: 60}, [], 2**62)
    joined = pseudo.joined_logs(pseudo.encoded(docs, vocabulary), counts, vocabulary)
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    found = sorted(r["joined"] for r in joined.collect())
    n = Counter(w for i in range(12) for w in words_of(f"b c{i} d{i % 3} é\u00a0{i % 2}"))
    wanted = sorted(sum(np.log(n[w]) for w in words_of(f"b c{i} d{i % 3} é\u00a0{i % 2}")) for i in range(12))
    assert found == pytest.approx(wanted)


def test_training_helps_held_out_documents(spark):
    """Trained on half of the documents, the others get likelier than by word frequencies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    learned, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1").toPandas()
    vocabulary = pseudo.vocabulary(learned)
    ids, at, _ = pseudo._joined(vocabulary.size, map(vocabulary.ids, held["text"]))
    plain = pseudo.initial(vocabulary).copy()
    near, top, low = pseudo.parts(plain, vocabulary.size)
    near[...], top[:-1], low[:, :-1] = 0, 0, 0  # all but the biases
    trained = pseudo.train(learned, vocabulary)
    mean = lambda w: pseudo.log_probabilities(vocabulary, w, ids, at).mean()
    assert mean(trained) > mean(plain) + 0.05


def test_odd_and_empty(spark):
    n = len(odd_rows())
    for operator in (syncmers.fingerprints, language.identify, pii.find, pseudo.score):
        found = table(operator(odd(spark)))
        assert len(found) == n
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in odd_rows())
        assert operator(none(spark)).count() == 0
    assert licenses.scan(licenses.laid_out(odd(spark))).count() == n
    assert licenses.scan(licenses.laid_out(none(spark))).count() == 0
    rejected = {r[0] for r in odd_rows()} - {r["doc_id"] for r in table(language.keep_identified(odd(spark)))}
    assert rejected == {4, 5, 6, 7}
    assert {r["doc_id"]: r["lang_pred"] for r in table(language.identify(odd(spark)))}[7] == "und"


def test_documents_stay_without_a_model(spark):
    """Nothing to learn from: no labels, or only held-out labels. Texts with a letter stay, with the lang they had."""
    texts = [(1, "plain words", None), (2, "12345 !!", None), (None, "no id", None), (4, None, None)]
    unlabelled = table(language.keep_identified(frame(spark, texts, ", lang string")))
    assert sorted(map(repr, unlabelled)) == sorted(repr(dict(zip(("doc_id", "text", "lang"), t))) for t in (texts[0], texts[2]))
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == language.HELD_OUT]
    texts = [(i, f"words of {i}", "en" if i % 2 else None) for i in held]
    kept = table(language.keep_identified(frame(spark, texts, ", lang string")))
    assert len(held) > 4 and {(r["doc_id"], r["lang"]) for r in kept} == {(i, lang) for i, _, lang in texts}
