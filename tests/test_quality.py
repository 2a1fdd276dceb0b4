import math

import numpy as np
import pandas as pd
import pytest
from helpers import by, rows
from data import half_empty, patients_file, random_frame, readings, repeats, score_only_outlier, spiked
from pyspark.sql import functions as F

from plumbline.columns import UnknownColumn
from plumbline.operators import outliers, profile, readiness
from plumbline.sources.files import read_csv

COMPONENTS = ["missingness", "duplicates", "constants", "high_missing_columns", "outliers"]


def score(df):
    return readiness.readiness_score(df).first().asDict()


def flags(values, method):
    q1, q3 = values.quantile([0.25, 0.75])
    fence = (values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))
    far = ((values - values.mean()) / values.std()).abs() > 3
    return {"iqr": fence, "zscore": far, "both": fence | far}[method]


def expected_components(frame):
    """The five components from their definition."""
    missing = frame.isna().mean()
    found = [flags(frame[c].dropna(), "both").sum() for c in frame.select_dtypes("number")]
    ratios = [
        missing.mean(), frame.duplicated().mean(), (frame.nunique() <= 1).mean(), (missing > 0.4).mean(),
        sum(found) / sum(n + 1 for n in found),
    ]
    return [max(0.0, 100 - p * r) for p, r in zip((120, 150, 200, 250, 80), ratios)]


@pytest.mark.parametrize("make", [readings, half_empty, repeats, spiked])
def test_readiness_from_its_definition(spark, make):
    frame = make()
    found, want = score(spark.createDataFrame(frame)), expected_components(frame)
    assert [found[c] for c in COMPONENTS] == pytest.approx(want, abs=0.0051)
    assert found["overall"] == pytest.approx(np.mean(want), abs=0.011)
    assert make is not readings or found["overall"] == 100


def test_empty_frame(spark):
    report = readiness.quality_report(spark.createDataFrame([], "a double, b string"))
    found = report.dataset.first()
    assert found["overall"] == 0 and found["notes"] == ["Empty dataset"]
    assert all(found[c] is None for c in COMPONENTS)
    assert [r["n_unique"] for r in report.columns.collect()] == [0, 0]


def test_missing_column_notes(spark):
    found = score(spark.createDataFrame(half_empty()))
    assert "High average missingness; consider aggressive cleaning." in found["notes"]
    assert "Notable duplicate rows present." in found["notes"]


@pytest.mark.parametrize("value, band", [
    (95, "Ready"), (80, "Minor fixes needed"), (60, "Needs work"), (40, "Not ready"), (90, "Ready"),
])
def test_bands(spark, value, band):
    frame = spark.createDataFrame([(float(value),)], "v double")
    assert frame.select(readiness.readiness_band(F.col("v"))).first()[0] == band


@pytest.mark.parametrize("method", ["iqr", "zscore", "both"])
def test_outlier_methods(spark, method):
    frame = spiked()
    found = outliers.outlier_counts(spark.createDataFrame(frame), method=method).first()
    assert found["outlier_count"] == flags(frame["level"], method).sum() > 0
    q1, q3 = frame["level"].quantile([0.25, 0.75])
    if method == "zscore":
        assert found["lower_bound"] is None
    else:
        assert math.isclose(found["lower_bound"], q1 - 1.5 * (q3 - q1))
        assert math.isclose(found["upper_bound"], q3 + 1.5 * (q3 - q1))


@pytest.mark.parametrize("method, count", [("iqr", 0), ("zscore", 1), ("both", 1)])
def test_value_beyond_the_score_but_not_the_fence(spark, method, count):
    df = spark.createDataFrame(score_only_outlier())
    assert outliers.outlier_counts(df, method=method).first()["outlier_count"] == count


def test_report_of_a_file_against_pandas(spark, tmp_path):
    path = patients_file(tmp_path)
    frame, df = pd.read_csv(path), read_csv(spark, path)
    report = readiness.quality_report(df)
    columns = by(report.columns, "column")
    assert list(frame.columns) == df.columns
    outliers_found, density = 0, 0
    for name in frame.columns:
        assert columns[name]["n_missing"] == frame[name].isna().sum()
        assert columns[name]["n_unique"] == frame[name].nunique()
        if frame[name].dtype == object:
            continue
        for measure, value in expected_summary(frame[name]).items():
            found = columns[name]["outlier_count" if measure == "outliers" else measure]
            assert found == pytest.approx(value), (name, measure)
        outliers_found += columns[name]["outlier_count"]
        density += columns[name]["outlier_count"] + 1
    assert outliers_found > 0
    found = report.dataset.first()
    assert found["outliers"] == pytest.approx(100 - 80 * outliers_found / density, abs=0.006)
    assert found["missingness"] == pytest.approx(100 - 120 * frame.isna().mean().mean(), abs=0.006)
    assert found["overall"] == pytest.approx(sum(found[c] for c in COMPONENTS) / 5, abs=0.006)


def expected_summary(series):
    x = series.dropna()
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    fence = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    z = (x - x.mean()).abs() / x.std() > 3 if x.std() > 0 else fence & False
    return {
        "mean": x.mean(), "std": x.std(), "min": x.min(), "q1": q1, "median": x.median(), "q3": q3,
        "max": x.max(), "iqr": q3 - q1, "outliers": int((fence | z).sum()),
    }


def check_against_pandas(spark, seed):
    frame = random_frame(seed)
    df = spark.createDataFrame(frame)
    report = readiness.quality_report(df)
    columns = by(report.columns, "column")
    for name in frame.columns:
        row = columns[name]
        assert row["n_missing"] == int(frame[name].isna().sum())
        assert row["n_unique"] == frame[name].nunique()
        assert row["is_constant"] == (frame[name].nunique() <= 1)
        if name == "group":
            continue
        for measure, value in expected_summary(frame[name]).items():
            found = row["outlier_count" if measure == "outliers" else measure]
            assert found == pytest.approx(value, abs=1e-12), (name, measure)
    duplicates = report.duplicates.first()
    assert duplicates["duplicate_count"] == int(frame.duplicated().sum())


@pytest.mark.parametrize("seed", [1, 2])
def test_report_against_pandas(spark, seed):
    check_against_pandas(spark, seed)


@pytest.mark.parametrize("seed", [1, 3])
def test_report_in_slices_against_pandas(spark, sliced, seed):
    check_against_pandas(spark, seed)


def test_approximate_report(spark):
    frame = random_frame(5, 300)
    columns = by(readiness.quality_report(spark.createDataFrame(frame), exact=False).columns, "column")
    assert columns["skewed"]["median"] == pytest.approx(frame["skewed"].median(), rel=0.1)
    # The sketch has a standard error of 5 %; three of them must do.
    assert columns["whole"]["n_unique"] == pytest.approx(frame["whole"].nunique(), rel=0.15)


def test_sketched_quartiles_are_close_in_rank(spark):
    values = np.random.RandomState(9).lognormal(0, 3, 200_000)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(16)
    found = outliers.numeric_summary(df, exact=False).first()
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs((values <= found[name]).mean() - p) < 0.005


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "v double, s string")
    assert outliers.numeric_summary(df, exact=False).first()["median"] is None
    report = readiness.quality_report(df.filter("false"), exact=False)
    assert report.dataset.first()["overall"] == 0
    assert readiness.quality_report(df.select("s"), exact=False).dataset.first()["n_rows"] == 2


def test_nested_binary_and_odd_types(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
           (array(1.0D, 2.0D), map('a', 1, 'b', 2), X'0102', true, DATE'2024-01-01', 1.10BD, struct(1 AS x)),
           (array(1.0D, 2.0D), map('b', 2, 'a', 1), X'0102', true, DATE'2024-01-01', 1.10BD, struct(1 AS x)),
           (NULL, NULL, NULL, NULL, NULL, NULL, NULL)
           AS t(arr, m, bin, flag, day, price, s)"""
    )
    report = readiness.quality_report(df)
    columns = by(report.columns, "column")
    assert {n: columns[n]["semantic_type"] for n in columns} == {
        "arr": "unknown", "m": "unknown", "bin": "unknown", "s": "unknown", "flag": "boolean",
        "day": "datetime", "price": "numeric_categorical",
    }
    assert columns["arr"]["n_missing"] == 1 and columns["arr"]["n_unique"] is None
    assert columns["price"]["mean"] == pytest.approx(1.1)
    # Maps with the same entries in another order are the same value.
    assert report.duplicates.first()["duplicate_count"] == 1


def test_nan_is_missing_and_long_texts_are_compared_whole(spark):
    long = "x" * 500
    df = spark.createDataFrame(
        [(float("nan"), long + "a"), (None, long + "b"), (1.0, long + "a")], "v double, text string"
    )
    assert by(profile.missing_profile(df), "column")["v"]["n_missing"] == 2
    assert by(profile.distinct_counts(df), "column")["text"]["n_unique"] == 2
    assert profile.duplicate_rows(df.select("text")).first()["duplicate_count"] == 1


def test_large_integers_stay_apart(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "v bigint")
    assert profile.distinct_counts(df).first()["n_unique"] == 2


def test_single_row_and_all_missing(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    found = by(readiness.quality_report(df).columns, "column")
    assert found["a"]["std"] is None and found["a"]["outlier_count"] == 0
    assert found["b"]["is_constant"] and found["b"]["is_all_unique"] and found["b"]["q1"] is None


def test_remove_and_clip(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in [*range(20), 500]] + [(None, 2.0)], "v double, w double")
    metadata = outliers.outlier_metadata(df)
    assert rows(metadata.select("column", "outlier_count")) == [
        {"column": "v", "outlier_count": 1}, {"column": "w", "outlier_count": 1},
    ]
    assert outliers.remove_outliers(df, metadata, ["V"]).count() == 20  # the missing row goes too
    clipped = outliers.clip_outliers(df, metadata, ["v"])
    assert clipped.filter("v IS NULL").count() == 1 and clipped.agg(F.max("v")).first()[0] < 500
    no_bounds = outliers.outlier_metadata(df, method="zscore")
    assert outliers.remove_outliers(df, no_bounds).count() == df.count()
    with pytest.raises(UnknownColumn):
        outliers.remove_outliers(df, metadata, ["other"])
    assert outliers.remove_outliers(df, metadata.filter("false")).count() == df.count()
    assert outliers.outlier_options(metadata.filter("false")).count() == 0


def test_bad_arguments(spark):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    with pytest.raises(ValueError):
        outliers.outlier_counts(df, method="other")
    with pytest.raises(TypeError):
        outliers.outlier_rows(df, "s")
    with pytest.raises(ValueError):
        outliers.numeric_summary(df, ["nothing"])


def test_infinite_values_do_not_fail(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, float("inf")]], "v double")
    assert outliers.numeric_summary(df).first()["max"] == np.inf
    assert outliers.outlier_counts(df, method="iqr").first()["outlier_count"] == 1


def test_one_hot_value(spark, sliced):
    """A third of all rows share one value; ranks count them all."""
    frame = pd.DataFrame({"v": [5.0] * 1000 + list(np.arange(2000) / 7.0)})
    found = outliers.numeric_summary(spark.createDataFrame(frame)).first()
    assert [found["q1"], found["median"], found["q3"]] == pytest.approx(
        list(frame["v"].quantile([0.25, 0.5, 0.75]))
    )
