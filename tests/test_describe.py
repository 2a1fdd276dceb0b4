import numpy as np
import pandas as pd
import pytest
from helpers import by, rows
from data import patients_file, random_frame

from plumbline.operators import describe
from plumbline.sources.files import read_csv


def test_file_against_pandas(spark, tmp_path):
    path = patients_file(tmp_path)
    frame, df = pd.read_csv(path), read_csv(spark, path)
    expected = frame.corr(numeric_only=True)
    found = describe.correlation_matrix(df).collect()
    assert len(found) == expected.size
    for r in found:
        assert r["correlation"] == pytest.approx(expected.loc[r["col_a"], r["col_b"]])
    groups = by(describe.bivariate(df, "Outcome", "Glucose"), "category")
    expected = frame.groupby("Outcome")["Glucose"].agg(["count", "mean", "median", "std", "min", "max"])
    assert set(groups) == {"0", "1", "O"}
    for name, row in expected.iterrows():
        assert [groups[name][c] for c in expected.columns] == pytest.approx(list(row))
    cells = {(r["x"], r["y"]): r["count"] for r in describe.bivariate(df, "Outcome", "City").collect()}
    table = pd.crosstab(frame["Outcome"], frame["City"])
    assert cells == {(x, y): table.loc[x, y] for x in table.index for y in table.columns}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairwise_complete_correlation(spark, seed):
    frame = random_frame(seed).drop(columns="group")
    frame["only once"] = np.where(frame["whole"].notna(), np.nan, 3.0)  # never beside `whole`
    expected = frame.corr()
    for r in describe.correlation_matrix(spark.createDataFrame(frame)).collect():
        value = expected.loc[r["col_a"], r["col_b"]]
        if np.isnan(value) or "constant" in (r["col_a"], r["col_b"]) or "only once" in (r["col_a"], r["col_b"]):
            assert r["correlation"] is None, r
        else:
            assert r["correlation"] == pytest.approx(value, abs=1e-12)


def test_correlation_far_from_zero(spark):
    """Deviations, not raw products: a large offset does not cancel."""
    rng = np.random.RandomState(0)
    x = rng.normal(0, 1, 500)
    frame = pd.DataFrame({"x": x + 1e9, "y": x * 2 + rng.normal(0, 1, 500) - 1e9})
    frame["z"] = frame["y"].where(rng.rand(500) > 0.3)
    expected = frame.corr()
    for r in describe.correlation_pairs(spark.createDataFrame(frame)).collect():
        assert r["correlation"] == pytest.approx(expected.loc[r["col_a"], r["col_b"]], abs=1e-6)


def test_pairs_in_batches(spark, monkeypatch):
    monkeypatch.setattr(describe, "PAIRS_PER_SCAN", 2)
    frame = random_frame(4).drop(columns=["group", "constant"])
    found = describe.correlation_pairs(spark.createDataFrame(frame)).collect()
    assert len(found) == 6
    for r in found:
        assert r["correlation"] == pytest.approx(frame[r["col_a"]].corr(frame[r["col_b"]]), abs=1e-12)


def test_constant_column_in_a_pair(spark):
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1), (3.0, 0.1)], "x double, c double")
    found = describe.bivariate_numeric(df, "x", "c").first()
    assert found["correlation"] is None and found["n_complete"] == 3


@pytest.mark.parametrize("slices", [False, True])
def test_univariate_against_pandas(spark, request, slices):
    if slices:
        request.getfixturevalue("sliced")
    frame = random_frame(6)
    found = by(describe.univariate_numeric(spark.createDataFrame(frame)), "column")
    for name in frame.columns.drop("group"):
        modes = frame[name].mode()
        row = found[name]
        assert row["n"] == len(frame) and row["n_missing"] == frame[name].isna().sum()
        assert row["median"] == pytest.approx(frame[name].median())
        assert (row["mode"], row["mode_tie_count"]) == (pytest.approx(modes.iloc[0]), len(modes))


def test_all_missing_numeric(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    found = describe.univariate_numeric(df).first()
    assert found["n_missing"] == 2 and found["n_outliers"] is None and found["mode"] is None


def test_modes_are_all_given(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 2.0, 2.0, 3.0, None, None, None]], "v double")
    assert sorted(r["value"] for r in describe.mode_ties(df).collect()) == [1.0, 2.0]


def test_values_and_categories_with_missing(spark):
    df = spark.createDataFrame([("a", "u"), ("a", None), (None, "u"), ("b", "u")], "x string, y string")
    counted = rows(describe.value_counts(df, "x"))
    assert counted[0] == {"value": "a", "is_missing": False, "count": 2, "share": 0.5}
    assert sum(r["is_missing"] for r in counted) == 1
    cells = {(r["x"], r["y"]): (r["count"], r["expected"]) for r in describe.contingency_expected(df, "x", "y").collect()}
    assert len(cells) == 6  # zeros included, missing values as levels
    assert cells["b", None] == (0, 0.25) and cells["a", "u"] == (1, 1.5) and cells[None, None] == (0, 0.25)
    assert len(describe.contingency_cells(df, "x", "y").collect()) == 4


def test_many_levels_on_both_sides(spark):
    """Cells of 12,000 by 12,000 levels; zeros are given where they are asked for."""
    df = spark.range(12_000).selectExpr("CAST(id AS STRING) AS x", "CAST((id * 7) % 12000 AS STRING) AS y")
    found = describe.bivariate(df, "x", "y")
    assert found.count() == 12_000 and found.agg({"expected": "max"}).first()[0] == pytest.approx(1 / 12_000)
    few = df.limit(300)
    assert describe.contingency_counts(few, "x", "y").count() == 90_000
    assert describe.contingency_proportions(few, "x", "y", zeros=False).count() == 300


def test_infinities_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 1.0, 2.0), (float("inf"), 3.0, 2.0), (4.0, 9.0, 2.0)], "a double, b double, c double")
    found = {(r["col_a"], r["col_b"]): r["correlation"] for r in describe.correlation_matrix(df).collect()}
    assert found["b", "b"] == 1.0
    assert all(v is None for k, v in found.items() if k != ("b", "b"))


def test_modes_keep_all_digits(spark):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740993,), (1,)], "v bigint")
    assert describe.univariate_numeric(df).first()["mode_text"] == "9007199254740993"


def test_categories_of_numbers_alone(spark):
    df = spark.range(3)
    assert describe.category_counts(df).count() == 0
    assert describe.univariate_categorical(df).count() == 0


def test_long_categories_keep_their_text(spark):
    df = spark.createDataFrame([("x" * 500,), ("x" * 500,), ("y" * 500,)], "t string")
    assert {r["value"]: r["count"] for r in describe.category_counts(df).collect()} == {"x" * 500: 2, "y" * 500: 1}


def test_missing_group_keys_are_left_out(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("b", None)], "k string, v double")
    found = by(describe.group_summary(df, "v", "k"), "category")
    assert set(found) == {"a", "b"} and found["b"]["count"] == 0
