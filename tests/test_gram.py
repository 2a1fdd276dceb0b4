"""Sums over pairs of many columns, against pandas and against the plan of few columns."""

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import describe
from plumbline.plans import gram


def wide_frame(seed, n=400, columns=23):
    rng = np.random.RandomState(seed)
    base = rng.normal(size=(n, 4))
    x = base @ rng.normal(size=(4, columns)) + rng.normal(size=(n, columns)) + 1e6 * rng.rand(columns)
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(columns)])
    for i in range(0, columns, 2):
        frame.loc[rng.rand(n) < rng.choice([0.05, 0.6]), f"c{i}"] = np.nan
    frame["c3"] = 7.25  # constant
    frame["c4"] = np.where(rng.rand(n) < 0.01, 5.0, np.nan)  # constant and rare
    frame["c5"] = np.where(frame["c6"].notna(), 2.0, frame["c5"])  # constant where c6 is present
    frame["c7"] = np.nan
    frame.loc[3, "c8"] = np.inf
    return frame


def pairs(df):
    return {(r["col_a"], r["col_b"]): (r["n_complete"], r["correlation"]) for r in describe.correlation_pairs(df).collect()}


@pytest.mark.parametrize("tile, panel, rows", [(256, 2048, 2048), (5, 2048, 17), (4, 10, 64)])
def test_pairs_against_the_plan_of_few_columns(spark, monkeypatch, tile, panel, rows):
    for name, value in (("TILE", tile), ("PANEL", panel), ("ROWS", rows)):
        monkeypatch.setattr(gram, name, value)
    frame = wide_frame(1)
    df = spark.createDataFrame(frame).repartition(5)
    found = pairs(df)
    monkeypatch.setattr(describe, "PAIRS_PER_SCAN", 1000)
    expected = pairs(df)
    assert set(found) == set(expected) and len(found) == 23 * 22 // 2
    for pair, (n, corr) in expected.items():
        assert found[pair][0] == n, pair
        assert found[pair][1] == (None if corr is None else pytest.approx(corr, abs=1e-9)), pair
    known = frame.replace(np.inf, np.nan).corr(min_periods=2)
    assert found["c0", "c1"][1] == pytest.approx(known.loc["c0", "c1"])
    assert found["c0", "c8"][1] is None and found["c5", "c6"][1] is None and found["c1", "c7"] == (0, None)


def test_a_thousand_columns_take_two_scans(spark):
    """One row of two shows it: the plan reads its input once, however many pairs there are."""
    names = [f"CAST(id * {i + 1} % 1009 AS DOUBLE) AS v{i}" for i in range(300)]
    made = describe.correlation_pairs(spark.range(500).selectExpr(*names))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 500") == 1
    assert made.count() == 300 * 299 // 2


def test_no_rows(spark):
    df = spark.createDataFrame(wide_frame(2)).filter("c0 < -1e9")
    found = pairs(df)
    assert len(found) == 23 * 22 // 2 and set(found.values()) == {(0, None)}
