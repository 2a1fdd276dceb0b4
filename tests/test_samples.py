"""Samples of exact size, bootstrap intervals, and the lineage of all datasets."""

import numpy as np
import pandas as pd
import pytest
from helpers import by, rows

from plumbline import thresholds
from plumbline.catalog import datasets
from plumbline.operators import advisories, charts
from plumbline.plans import draw


@pytest.mark.parametrize("margin", [8.0, 0.01])
def test_exact_sizes_on_any_partitioning(spark, monkeypatch, margin):
    """Also when the first margins miss their thresholds and must be widened."""
    monkeypatch.setattr(thresholds, "DRAW_MARGIN", margin)
    df = spark.range(4000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id < 40 THEN 'few' WHEN id % 5 = 1 THEN NULL ELSE 'rest' END AS k",
        "CAST(id % 9 AS DOUBLE) AS v",
    )
    counts = {r["k"]: r["n"] for r in df.groupBy("k").count().withColumnRenamed("count", "n").collect()}
    drawn = rows(advisories.sized_sample(df.repartition(7), "k", 300, seed=3, key=["id"]), "id")
    assert pd.Series([str(r["k"]) for r in drawn]).value_counts().to_dict() == {str(k): min(300, n) for k, n in counts.items()}
    assert drawn == rows(advisories.sized_sample(df.repartition(2), "k", 300, seed=3, key=["id"]), "id")
    other = rows(advisories.sized_sample(df, "k", {"hot": 50, None: 2, "gone": 9}, seed=3, key=["id"]), "id")
    assert [sum(r["k"] == k for r in other) for k in ("hot", None, "few", "rest")] == [50, 2, 0, 0]
    assert {r["id"] for r in other} <= {r["id"] for r in drawn}  # a larger sample keeps a smaller one
    assert advisories.sized_sample(df, "k", 0).count() == 0
    assert advisories.sized_sample(df.filter("id < 0"), "k", 5).count() == 0
    with pytest.raises(ValueError):
        advisories.sized_sample(df, "k", -1)


def test_samples_of_repeated_rows(spark):
    """Equal rows have one draw: so many of them are taken as are wanted."""
    data = [("a", 1, [1])] * 500 + [("a", i, [i]) for i in range(100)] + [("b", 2, None)] * 30
    df = spark.createDataFrame(data, "x0_ string, room int, held array<int>").repartition(6)
    for size in (1, 120, 450, 599, 600, 10_000):
        found = rows(advisories.sized_sample(df, "x0_", size, seed=1))
        assert sum(r["x0_"] == "a" for r in found) == min(size, 600) and sum(r["x0_"] == "b" for r in found) == min(size, 30)
        assert sum(r["room"] == 1 and r["x0_"] == "a" for r in found) <= 501
    points = spark.createDataFrame([(1.0, 2.0)] * 80 + [(None, 1.0)] * 9, "x double, y double")
    assert charts.scatter_points(points, "x", "y", rows=33).count() == 33
    assert charts.scatter_points(points, "x", "y", rows=100).count() == 80
    with pytest.raises(ValueError):
        charts.scatter_points(points, "x", "y", fraction=0.1, rows=3)


def test_only_the_margin_is_numbered(spark, monkeypatch):
    """Of 100,000 rows, a sample of 20,000 numbers a few thousand near its threshold."""
    seen = []
    keep = draw.stage
    monkeypatch.setattr(draw, "stage", lambda df: seen.append(keep(df)) or seen[-1])
    df = spark.range(100_000).selectExpr("id", "1 AS k")
    assert advisories.sized_sample(df, "k", 20_000, key=["id"]).count() == 20_000
    assert 0 < seen[-1].count() < 4000


def test_bootstrap_covers_the_mean(spark):
    """Of 200 samples of a skewed population, about 95 % of the intervals hold its mean."""
    rng = np.random.RandomState(6)
    frame = pd.DataFrame({"g": np.repeat(np.arange(200), 60), "id": np.arange(12_000), "v": rng.exponential(3.0, 12_000)})
    df = spark.createDataFrame(frame).repartition(5)
    found = charts.bootstrap_means(df, "g", "v", replicates=200, key=["id"]).toPandas()
    assert 0.88 <= ((found["ci_low"] <= 3) & (found["ci_high"] >= 3)).mean() <= 0.99
    normal = charts.bar_means(df, "g", "v").toPandas().set_index("g")
    width = (found.set_index("g")["ci_high"] - found.set_index("g")["ci_low"]) / (normal["ci_high"] - normal["ci_low"])
    assert 0.85 < width.mean() < 1.05
    again = by(charts.bootstrap_means(df.repartition(2), "g", "v", replicates=200, key=["id"]), "g")
    for r in found.to_dict("records"):
        assert again[r["g"]]["ci_low"] == pytest.approx(r["ci_low"]) and again[r["g"]]["n"] == 60


def test_bootstrap_of_few_and_missing_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0), ("b", 2.0), ("b", 2.0)], "k string, v double")
    found = by(charts.bootstrap_means(df, "k", "v", replicates=8), "k")
    assert set(found) == {"a", "b"} and (found["b"]["ci_low"], found["b"]["ci_high"], found["a"]["n"]) == (2.0, 2.0, 1)
    assert charts.bootstrap_means(df.filter("v > 9"), "k", "v").collect() == []
    with pytest.raises(ValueError):
        charts.bootstrap_means(df, "k", "v", replicates=2)


def walk(parents, name):
    at, seen = name, [name]
    while True:
        up = parents[at]
        if up is None or up not in parents:
            return at, len(seen) - 1, "root" if up is None else "unlisted"
        if up in seen:
            return None, None, "cycle"
        at = up
        seen.append(at)


@pytest.mark.parametrize("at_hand", [1, 8192])
def test_lineage_of_all_against_single_walks(spark, monkeypatch, at_hand):
    monkeypatch.setattr(thresholds, "GROUPS_AT_HAND", at_hand)
    rng = np.random.RandomState(3)
    parents = {f"d{i}": None if i == 0 or rng.rand() < 0.03 else f"d{rng.randint(max(0, i - 9), i)}" for i in range(250)}
    parents |= {f"s{i}": "d0" for i in range(80)}  # a root of many
    parents |= {"c0": "c2", "c1": "c0", "c2": "c1", "in": "c1", "self": "self", "lost": "nowhere", "after": "lost"}
    df = spark.createDataFrame([*parents.items(), (None, "d0"), ("d0", None)], "dataset_id string, parent_dataset_id string")
    found = {r["dataset_id"]: (r["root_id"], r["depth"], r["ends"]) for r in datasets.all_lineage(df.repartition(3)).collect()}
    assert found == {name: walk(parents, name) for name in parents}
    assert datasets.all_lineage(df.filter("dataset_id = 'none'")).collect() == []


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    seen = []
    keep = datasets.stage
    monkeypatch.setattr(datasets, "stage", lambda df: seen.append(1) or keep(df))
    n = 5000
    df = spark.range(n).selectExpr("concat('d', id) AS dataset_id", "IF(id > 0, concat('d', id - 1), NULL) AS parent_dataset_id")
    found = datasets.all_lineage(df)
    assert found.filter("root_id = 'd0' AND ends = 'root' AND dataset_id = concat('d', depth)").count() == n
    assert len(seen) <= 2 * 14 + 1  # two written tables a round
