import numpy as np
import pandas as pd
import pytest
from helpers import by
from pyspark.sql import functions as F

from plumbline import thresholds
from plumbline.operators import charts, describe
from plumbline.plans.ranks import bucket_sql, column_quantiles, group_quantiles, order_statistics

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def skewed_groups(seed, n=3000):
    """One group holds a third of the rows, one value of it a third of those."""
    rng = np.random.RandomState(seed)
    group = np.where(rng.rand(n) < 1 / 3, "hot", rng.choice([f"g{i}" for i in range(40)], n))
    value = np.round(rng.lognormal(0, 3, n), 3)
    value[(group == "hot") & (rng.rand(n) < 1 / 3)] = 1.5
    return pd.DataFrame({"k": group, "value": value})


@pytest.fixture
def rough(monkeypatch):
    """Sketches of few values, so that brackets miss most values even of small groups."""
    monkeypatch.setattr(thresholds, "SKETCH_SIZE", 200)
    monkeypatch.setattr(thresholds, "RANK_MARGIN", 0.1)


def test_group_quantiles(spark, rough):
    frame = skewed_groups(7)
    found = by(group_quantiles(spark.createDataFrame(frame).repartition(5), ["k"], "value", PROBS), "k")
    expected = frame.groupby("k")["value"].quantile(PROBS).unstack()
    assert set(found) == set(expected.index)
    for k in expected.index:
        assert found[k]["q"] == pytest.approx(list(expected.loc[k]))


@pytest.mark.parametrize("held", [3, 40, 5_000_000])
def test_column_quantiles_narrow_their_brackets(spark, monkeypatch, rough, held):
    monkeypatch.setattr(thresholds, "BRACKET_VALUES", held)
    frame = skewed_groups(9)
    frame["other"] = np.where(frame["k"] == "hot", np.inf, -frame["value"])
    frame["none"] = np.nan
    df = spark.createDataFrame(frame).replace(float("nan"), None).repartition(4)
    found = by(column_quantiles(df, ["value", "other", "none"], PROBS[1:-1]), "cid")
    assert set(found) == {0, 1}
    for i, name in enumerate(("value", "other")):
        assert found[i]["q"] == pytest.approx(list(frame[name].quantile(PROBS[1:-1]).fillna(np.inf)))


def test_no_exchange_carries_all_cells(spark):
    """Only values in brackets are grouped: two of a hundred here."""
    df = spark.range(200_000).selectExpr("CAST(id AS DOUBLE) AS v")
    found = column_quantiles(df, ["v"], [0.5])
    assert found.first()["q"] == [99_999.5]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "v#" in text and ">= " in text and "<= " in text and "percentile" not in text


@pytest.mark.parametrize("buckets", [1, 2, 7, 1024])
def test_every_rank(spark, monkeypatch, buckets):
    monkeypatch.setattr(thresholds, "RANK_BUCKETS", buckets)
    frame = skewed_groups(3, 800)
    targets = spark.range(len(frame)).select(F.col("id").alias("rank"))
    found = order_statistics(spark.createDataFrame(frame), "value", targets).orderBy("rank").collect()
    assert [r["value"] for r in found] == sorted(frame["value"])
    assert [r["rank"] for r in found] == list(range(len(frame)))


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(thresholds, "RANK_BUCKETS", 1)
    monkeypatch.setattr(thresholds, "BRACKET_VALUES", 100)
    df = spark.range(2_000).selectExpr("CAST((id * 7919) % 2000 AS DOUBLE) AS value")
    targets = spark.createDataFrame([(0,), (777,), (1999,), (2000,)], "rank long")
    found = order_statistics(df, "value", targets)
    assert sorted((r["rank"], r["value"]) for r in found.collect()) == [(0, 0.0), (777, 777.0), (1999, 1999.0)]
    assert order_statistics(df.filter("value < 0"), "value", targets).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 50])
def test_buckets(spark, n):
    bounds = [float(2 * i) for i in range(n)]
    rows = spark.range(-3, 2 * n + 3).selectExpr("id", f"{bucket_sql(bounds, 'CAST(id AS DOUBLE)')} AS bucket")
    assert all(r["bucket"] == sum(b <= r["id"] for b in bounds) for r in rows.collect())


def test_group_summary_and_boxes(spark, rough):
    frame = skewed_groups(5, 900)
    df = spark.createDataFrame(frame)
    medians = by(describe.group_summary(df, "value", "k"), "category")
    boxes = by(charts.box_stats(df, "value", ["k"]), "k")
    for k, values in frame.groupby("k")["value"]:
        q1, median, q3 = values.quantile([0.25, 0.5, 0.75])
        inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        assert medians[k]["median"] == pytest.approx(median)
        assert list(boxes[k])[1:] == pytest.approx(
            [len(values), q1, median, q3, inside.min(), inside.max(), len(values) - len(inside)]
        )


@pytest.mark.parametrize("held", [3, 40, 5_000_000])
@pytest.mark.parametrize("at_hand", [0, 4, 8192])
def test_group_quantiles_narrow_their_brackets(spark, monkeypatch, rough, held, at_hand):
    """Whatever is broadcast, whichever brackets are narrowed, and with infinite values."""
    monkeypatch.setattr(thresholds, "BRACKET_VALUES", held)
    monkeypatch.setattr(thresholds, "GROUPS_AT_HAND", max(1, at_hand))
    frame = skewed_groups(3)
    frame.loc[frame.index[:40], "value"] = np.inf
    df = spark.createDataFrame(frame).repartition(4)
    found = by(group_quantiles(df, ["k"], "value", PROBS[1:-1]), "k")
    expected = frame.groupby("k")["value"].quantile(PROBS[1:-1]).unstack()
    assert set(found) == set(expected.index)
    for k in expected.index:
        assert found[k]["q"] == pytest.approx(list(expected.loc[k].fillna(np.inf)))


def test_narrowed_brackets_hold_few_values(spark, monkeypatch):
    """One group of 300,000 values: no bracket keeps more than it may."""
    from plumbline.plans import ranks

    monkeypatch.setattr(thresholds, "BRACKET_VALUES", 500)
    seen = []
    keep = ranks._interpolated

    def look(found, by_, places):
        seen.append(found.filter("value IS NOT NULL").groupBy("k", "place").count().agg(F.max("count")).first()[0])
        return keep(found, by_, places)

    monkeypatch.setattr(ranks, "_interpolated", look)
    df = spark.range(300_000).selectExpr("IF(id % 1000 = 0, 'cold', 'hot') AS k", "CAST(id * 7919 % 300007 AS DOUBLE) AS v")
    found = by(group_quantiles(df, ["k"], "v", [0.25, 0.5]), "k")
    expected = df.toPandas().groupby("k")["v"].quantile([0.25, 0.5]).unstack()
    for k in ("hot", "cold"):
        assert found[k]["q"] == pytest.approx(list(expected.loc[k]))
    assert seen and max(seen) <= 500


def test_boxes_never_broadcast_or_pair_rows(spark):
    df = spark.range(2000).selectExpr("CAST(id % 37 AS DOUBLE) AS v", "id % 3 AS g")
    for keys in (None, ["g"]):
        plan = charts.box_stats(df, "v", keys)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert charts.box_stats(df.filter("v < 0"), "v").collect() == []


def test_boxes_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(thresholds, "GROUPS_AT_HAND", 5)
    frame = skewed_groups(5)
    df = spark.createDataFrame(frame).repartition(3)
    found = by(charts.box_stats(df, "value", ["k"]), "k")
    monkeypatch.setattr(thresholds, "GROUPS_AT_HAND", 8192)
    assert found == by(charts.box_stats(df, "value", ["k"]), "k")
    assert {k: r["n"] for k, r in found.items()} == frame.groupby("k").size().to_dict()
