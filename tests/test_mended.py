"""Results that were once wrong."""

import pytest
from helpers import by, rows

from plumbline.columns import UnknownColumn
from plumbline.functions.distributions import binomial_p
from plumbline.operators import advisories, charts, clean, describe, outliers, profile, wrangle
from plumbline.sources.files import IngestionError, read_csv


def test_binomial_tails_keep_their_digits():
    """Against sums of exact fractions."""
    from fractions import Fraction
    from math import comb

    def exact(lowest, highest, n):
        return float(Fraction(sum(comb(n, i) for i in range(lowest, highest + 1)), 2**n))

    assert binomial_p(300, 1000, 0.5, "less") == pytest.approx(exact(0, 300, 1000), rel=1e-9)
    assert binomial_p(700, 1000, 0.5, "greater") == pytest.approx(exact(700, 1000, 1000), rel=1e-9)
    assert binomial_p(300, 1000, 0.5, "two-sided") == pytest.approx(2 * exact(0, 300, 1000), rel=1e-9)
    assert binomial_p(0, 50, 0.5, "less") == pytest.approx(2.0**-50, rel=1e-9)


def test_ragged_rows_are_an_error(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text("a,b\n1,2\n3,4,99\n5,6\n")
    with pytest.raises(IngestionError):
        read_csv(spark, str(path))
    kept = rows(read_csv(spark, str(path), bad_rows="bad"), "a")
    assert [r["bad"] for r in kept] == [None, "3,4,99", None] and [r["a"] for r in kept][0] == 1


def test_numbers_are_not_dates(spark):
    df = spark.createDataFrame([("2020", "2020-01-02"), ("17", "x")], "n string, d string")
    found = by(advisories.type_consistency(df), "column")
    assert found["n"]["date_pct"] == 0 and found["d"]["date_pct"] == 0.5


def test_unknown_columns_are_not_removed_silently(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(20), 1000]], "value double")
    metadata = outliers.outlier_metadata(df)
    with pytest.raises(UnknownColumn):
        outliers.remove_outliers(df, metadata, ["valeu"])
    report = rows(outliers.removal_report(df, metadata))
    assert [(r["column"], r["n_rows"], r["n_outside"]) for r in report] == [("value", 21, 1), (None, 21, 1)]
    nothing = outliers.removal_report(df.filter("value < 100"), outliers.outlier_metadata(df.filter("value < 100")))
    assert nothing.first()["message"] == "No outliers to remove" and nothing.first()["n_outside"] == 0


def test_comparison_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    with pytest.raises(ValueError, match="no values"):
        charts.comparison_chart(df, "v", "histogram")


def test_examples_may_hold_any_character(spark):
    df = spark.createDataFrame([("a|b",)] * 200 + [("c",), (None,)], "t string")
    assert profile.example_values(df).first()["example_values"] == ["a|b", "c"]


def test_clipping_keeps_digits(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 1), (5, 2)], "v bigint, k int")
    bounds = spark.createDataFrame([("v", 6.0, 1e16)], "column string, lower_bound double, upper_bound double")
    assert [r["v"] for r in outliers.clip_outliers(df, bounds).orderBy("k").collect()] == [big, 6]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS k", "CAST(id AS DOUBLE) AS x", "CAST(-id AS DOUBLE) AS y")
    for draw in (
        lambda d: advisories.stratified_sample(d, "k", {0: 0.5, 1: 0.1}, seed=4, key=["id"]),
        lambda d: charts.scatter_points(d, "x", "y", fraction=0.3, seed=4),
    ):
        assert rows(draw(df.repartition(7)), *draw(df).columns) == rows(draw(df.repartition(2)), *draw(df).columns)
    assert 20 < advisories.stratified_sample(df, "k", {0: 0.5}).count() < 140


def test_imputing_measures_all_columns_at_once(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, "a"), (2.0, 1.0, "a"), (3.0, 50.0, "b"), (None, None, None)], "m double, s double, t string"
    )
    filled = wrangle.impute(df, ["m", "s", "t"]).filter("t = 'a'").orderBy("s", "m").collect()
    assert [tuple(r) for r in filled] == [(1.0, 1.0, "a"), (2.0, 1.0, "a"), (2.0, 1.0, "a")]


def test_cleaning_stops_measuring_what_has_not_changed(spark, monkeypatch):
    seen = []
    measure = clean.quality_report
    monkeypatch.setattr(clean, "quality_report", lambda df: seen.append(1) or measure(df))
    df = spark.range(100).selectExpr("id", "1 AS one", "IF(id < 90, NULL, id) AS few", "IF(id < 40, NULL, id) AS some")
    _, steps = clean.auto_clean(df)
    assert [r["rule"] for r in steps.orderBy("iteration").collect()][:2] == ["drop_sparse_columns", "drop_constant_columns"]
    assert len(seen) <= 2


def test_one_summary_of_all_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, None)], "n int, t string")
    found = by(describe.univariate(df), "column")
    assert (found["n"]["kind"], found["n"]["mode"], found["n"]["n_unique"]) == ("numeric", "2", None)
    assert (found["t"]["kind"], found["t"]["mode"], found["t"]["n_missing"], found["t"]["mean"]) == ("categorical", "a", 1, None)
    for only in ("n", "t"):
        assert describe.univariate(df, [only]).columns == describe.univariate(df).columns


def test_infinite_values_are_told_apart(spark):
    inf = float("inf")
    values = [(float(v), float(v % 7), inf if v == 5 else 1.0 * v) for v in range(60)]
    df = spark.createDataFrame(values, "a double, b double, c double")
    assert [r["column"] for r in advisories.leakage_hints(df.selectExpr("*", "2 * a AS twice"), "a").collect()] == ["twice"]
    pair = describe.bivariate_numeric(df, "a", "c").first()
    assert (pair["n_complete"], pair["correlation"], pair["covariance"]) == (60, None, None)
    bins = {r["bin"]: r for r in charts.histogram(df, "c", 4).collect()}
    assert set(bins) == {0, 1, 2, 3, 4} and bins[4]["upper"] == inf and bins[4]["count"] == 1
    assert sum(bins[b]["count"] for b in range(4)) == 59 and bins[0]["lower"] == 0 and bins[3]["upper"] == 59
    grid = charts.scatter_grid(df, "c", "b", 4).collect()
    assert sum(r["count"] for r in grid) == 60 and [r["count"] for r in grid if r["x_bin"] == 4] == [1]
    assert charts.scatter_grid(df.filter("c = 5"), "c", "b").collect() == []
    with pytest.raises(ValueError, match="finite"):
        charts.histogram(spark.createDataFrame([(inf,), (-inf,)], "v double"), "v")


def test_example_values_are_distinct_and_whole(spark):
    long = "x" * 500
    df = spark.createDataFrame(
        [(0.0, long, None), (-0.0, long, None), (float("nan"), "b", None), (2.5, None, None)], "v double, s string, e long"
    )
    found = {r["column"]: r["example_values"] for r in profile.example_values(df).collect()}
    assert found == {"v": ["0.0", "2.5"], "s": ["b", long]}
    assert profile.example_values(df.limit(0)).count() == 0
