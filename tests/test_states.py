"""Profiles merged from the states of parts."""

import numpy as np
import pandas as pd
import pytest
from helpers import by

from plumbline.operators import states


def frame(n=4000):
    rng = np.random.RandomState(2)
    made = pd.DataFrame({
        "far": 1e9 + rng.normal(size=n), "skewed": rng.lognormal(0, 2, n), "whole": rng.randint(0, 700, n),
        "text": rng.choice([f"t{i}" for i in range(500)], n), "part": rng.choice([0, 1, 2, 2, 2, 2], n),
    })
    made.loc[rng.rand(n) < 0.2, "skewed"] = np.nan
    made.loc[made["part"] == 1, "skewed"] = np.nan  # a part without values
    return made


def test_parts_give_the_report_of_their_union(spark, tmp_path):
    made = frame()
    df = spark.createDataFrame(made).repartition(3)
    kept = states.ProfileStates(spark, str(tmp_path / "states"))
    for p in (0, 1, 2):
        kept.add(df.filter(f"part = {p}").drop("part"), f"p{p}")
    kept.add(df.filter("part = 2").drop("part"), "p2")  # again: it counts once
    found = by(kept.report(), "column")
    assert set(found) == {"far", "skewed", "whole", "text"}
    for c in ("far", "skewed", "whole"):
        r, x = found[c], made[c]
        assert (r["n_rows"], r["n_missing"]) == (len(x), int(x.isna().sum()))
        assert r["mean"] == pytest.approx(x.mean(), rel=1e-12) and r["std"] == pytest.approx(x.std(), rel=1e-6)
        assert (r["min"], r["max"]) == (x.min(), x.max())
        assert r["n_unique"] == pytest.approx(x.nunique(), rel=0.03)
        for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert abs((x < r[q]).sum() / x.count() - p) < 0.01
    assert found["text"]["n_unique"] == pytest.approx(500, rel=0.03) and found["text"]["mean"] is None
    some = by(kept.report(["p0", "p1"]), "column")
    assert some["whole"]["n_rows"] == int((made["part"] < 2).sum())
    assert states.profile_state(df).columns == [f.split()[0] for f in states.STATE.split(", ")]


def test_empty_parts_and_other_columns(spark):
    df = spark.createDataFrame([(1.0, "a", [1]), (None, None, None)], "v double, t string, nested array<int>")
    parts = states.profile_state(df).unionByName(states.profile_state(df.filter("v > 5")))
    parts = parts.unionByName(states.profile_state(df.selectExpr("'x' AS v")))
    found = by(states.merged_report(parts), "column")
    assert set(found) == {"v", "t"} and found["v"]["family"] == "mixed"
    assert (found["v"]["n_rows"], found["v"]["n_missing"], found["v"]["mean"], found["v"]["std"]) == (4, 1, 1.0, None)
    assert (found["t"]["n_rows"], found["t"]["n_missing"], found["t"]["n_unique"]) == (2, 1, 1)
    with pytest.raises(ValueError):
        states.profile_state(df, ["nested"])
