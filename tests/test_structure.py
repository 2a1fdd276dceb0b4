"""Leakage by entropy, rules for flagged rows, and sets of missing columns, against plain counting."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import by

from plumbline import thresholds
from plumbline.operators import advisories, missingness, subgroups


def loo_entropy(pairs):
    """Predicting each row from the others of its level, plainly."""
    n = len(pairs)
    levels, cells, classes = Counter(x for x, _ in pairs), Counter(pairs), Counter(y for _, y in pairs)
    return -sum(math.log((cells[x, y] - 1 + classes[y] / n) / levels[x]) for x, y in pairs) / n


def leaky_frame(n=3000):
    rng = np.random.RandomState(4)
    y = rng.choice(["no", "yes", "maybe"], n, p=[0.7, 0.2, 0.1])
    frame = pd.DataFrame({"y": y})
    frame["code"] = np.where(y == "yes", "k1", rng.choice(["k2", "k3"], n))
    frame["twin"] = frame["y"].str.upper()
    frame["wave"] = np.select([y == "yes", y == "no"], [rng.choice([-5.0, 5.0], n), 0.0], rng.choice([-9.0, 9.0], n)) + rng.rand(n)
    frame["noise"] = rng.rand(n)
    frame["id"] = [f"row {i}" for i in range(n)]
    frame["gone"] = np.where(y == "maybe", np.nan, 1.0)
    frame["flat"] = 1
    return frame


@pytest.mark.parametrize("at_hand", [1, 8192])
def test_leaks_of_any_shape(spark, monkeypatch, at_hand):
    monkeypatch.setattr(thresholds, "GROUPS_AT_HAND", at_hand)
    frame = leaky_frame()
    df = spark.createDataFrame(frame).replace(float("nan"), None).repartition(5)
    found = by(advisories.leakage_scores(df, "y", bins=64), "column")
    assert {c for c, r in found.items() if r["is_leak"]} == {"twin", "wave"}
    assert found["id"]["explained"] < 1e-9 and found["id"]["n_levels"] == 3000
    assert found["noise"]["explained"] < 0.05 and found["flat"]["explained"] < 0.01
    assert 0.3 < found["code"]["explained"] < 0.8 and 0.3 < found["gone"]["explained"] < 0.8
    for c in ("code", "twin", "id", "flat"):
        assert found[c]["conditional_entropy"] == pytest.approx(max(0, loo_entropy(list(zip(frame[c], frame["y"], strict=True)))))


def test_leaks_of_a_numeric_target_and_of_nothing(spark):
    df = spark.range(4000).selectExpr("CAST(id % 101 AS DOUBLE) AS x", "pow(id % 101 - 50, 2) AS y", "rand(3) AS r", "'one' AS t")
    found = by(advisories.leakage_scores(df, "y", bins=101), "column")
    assert found["x"]["is_leak"] and not found["r"]["is_leak"]  # the correlation of x and y is 0
    assert {r["explained"] for r in advisories.leakage_scores(df, "t").collect()} == {None}
    assert advisories.leakage_scores(df.filter("x < 0"), "t").collect() == []
    with pytest.raises(ValueError):
        advisories.leakage_scores(df.select("t"), "t")


def plain_rules(frame, flagged, columns, depth, least_share, least_lift):
    """Every conjunction of levels, counted one by one."""
    least = max(1, math.ceil(least_share * flagged.sum()))
    stats = {}
    for size in range(1, depth + 1):
        for cs in itertools.combinations(columns, size):
            groups = pd.DataFrame({"f": flagged}).groupby([frame[c].fillna("missing") for c in cs])["f"].agg(["size", "sum"])
            for key, (n, f) in groups.iterrows():
                if f >= least:
                    stats[tuple(zip(cs, key if isinstance(key, tuple) else (key,), strict=True))] = (n, f)
    base = flagged.mean()
    told = {}
    for rule, (n, f) in stats.items():
        parts = [tuple(r for r in rule if r != left) for left in rule] if len(rule) > 1 else []
        if f / n / base >= least_lift and all(f / n > stats[p][1] / stats[p][0] for p in parts):
            text = " and ".join(f"{c} is missing" if level == "missing" else f"{c} = {level}" for c, level in rule)
            told[text] = (n, f)
    return told


@pytest.mark.parametrize("at_hand", [2, 8192])
@pytest.mark.parametrize("depth", [1, 2, 3])
def test_rules_against_all_conjunctions(spark, monkeypatch, depth, at_hand):
    monkeypatch.setattr(thresholds, "GROUPS_AT_HAND", at_hand)
    rng = np.random.RandomState(8)
    n = 1500
    frame = pd.DataFrame({c: rng.choice(list("pqr"), n, p=[0.6, 0.3, 0.1]) for c in "abcd"})
    frame.loc[rng.rand(n) < 0.1, "b"] = None
    chance = np.where((frame["a"] == "q") & (frame["c"] == "p") & frame["b"].notna(), 0.7, 0.05)
    frame["f"] = rng.rand(n) < chance
    found = subgroups.flag_rules(spark.createDataFrame(frame).repartition(4), "f", list("abcd"), depth, 0.04, 1.2)
    got = {r["rule"]: (r["n"], r["n_flagged"]) for r in found.collect()}
    assert got == plain_rules(frame, frame["f"], list("abcd"), depth, 0.04, 1.2)
    if depth > 1:  # the planted rule is the best of those that cover at least half of what it causes
        best = found.filter("coverage > 0.5").orderBy("lift", ascending=False).first()["rule"]
        assert best.startswith("a = q and c = p") or best == "a = q and b = p and c = p"


def test_rules_for_outliers(spark):
    df = spark.range(5000).selectExpr(
        "IF(id % 50 = 3 AND id % 4 = 1, 900 + id % 7, id % 40) + 0D AS v", "id % 50 = 3 AS odd", "CAST(id % 4 AS STRING) AS k",
        "CAST(id AS DOUBLE) AS serial",
    )
    best = subgroups.outlier_rules(df, "v").orderBy("lift", ascending=False).first()
    assert best["rule"] == "odd = true and k = 1" and best["share"] == 1 and best["coverage"] == 1
    assert subgroups.flag_rules(df, "v < 0", ["k"]).collect() == []
    assert subgroups.flag_rules(df.filter("v < 0"), "v > 0", ["k", "serial"]).collect() == []
    with pytest.raises(ValueError):
        subgroups.flag_rules(df, "odd", ["k"], least_share=0)


@pytest.mark.parametrize("seed", range(4))
def test_closed_sets_against_all_sets(spark, seed):
    rng = np.random.RandomState(seed)
    n, names = 300, list("abcdefg")
    gaps = rng.rand(n, 7) < rng.choice([0.05, 0.3, 0.6], 7)
    gaps[:, 1] |= gaps[:, 0]  # b is missing wherever a is
    gaps[:, 5] = gaps[:, 4]
    gaps[:, 6] = seed == 2
    data = [tuple(None if g else 1 for g in row) for row in gaps]
    df = spark.createDataFrame(data, ", ".join(f"{c} int" for c in names)).repartition(3)
    found = {r["pattern"]: (r["size"], r["n_rows"]) for r in missingness.missing_sets(df, least_share=0.04).collect()}
    count = {s: int(gaps[:, list(s)].all(axis=1).sum()) for k in range(8) for s in itertools.combinations(range(7), k)}
    expected = {
        " + ".join(names[i] for i in s): (len(s), m)
        for s, m in count.items()
        if s and m >= 0.04 * n and all(count[tuple(sorted({*s, i}))] < m for i in range(7) if i not in s)
    }
    assert found == expected


def test_many_columns_missing_together_are_one_set(spark):
    """Their 2 ** 40 subsets are never made."""
    names = [f"c{i}" for i in range(40)]
    df = spark.range(200).selectExpr(*[f"IF(id % 2 = 0, NULL, id) AS {c}" for c in names])
    found = missingness.missing_sets(df).collect()
    assert [(r["size"], r["n_rows"], r["share"]) for r in found] == [(40, 100, 0.5)]
    assert missingness.missing_sets(df.filter("c0 < 0")).collect() == []
    assert missingness.missing_sets(df.filter("c0 IS NOT NULL")).collect() == []


def test_dependence_of_missing_values(spark):
    rng = np.random.RandomState(1)
    gaps = rng.rand(400, 3) < 0.3
    data = [(*[None if g else 1.0 for g in row], None if row[0] else 2.0, 1.0 if row[0] else None, None, 3.0) for row in gaps]
    df = spark.createDataFrame(data, "a double, b double, c double, same double, other double, never double, full double")
    found = {(r["col_a"], r["col_b"]): r for r in missingness.missing_dependence(df).collect()}
    assert set(found) == set(itertools.combinations(["a", "b", "c", "same", "other", "never"], 2))
    assert found["a", "same"]["phi"] == pytest.approx(1) and found["a", "other"]["phi"] == pytest.approx(-1)
    assert found["a", "b"]["phi"] == pytest.approx(np.corrcoef(gaps[:, 0], gaps[:, 1])[0, 1])
    assert found["a", "never"]["phi"] is None and found["a", "other"]["n_both"] == 0
