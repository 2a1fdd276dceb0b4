import pytest
from data import readings

from plumbline.columns import UnknownColumn
from plumbline.operators import describe, wrangle


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(readings())


def test_filter_and_select(sites):
    assert wrangle.filter_rows(sites, "flow > 500").count() == (readings()["flow"] > 500).sum()
    assert wrangle.select_columns(sites, ["height", "depth"]).columns == ["height", "depth"]
    with pytest.raises(UnknownColumn, match="fluw"):
        wrangle.select_columns(sites, ["fluw"])
    assert wrangle.drop_columns(sites, ["SITE"]).columns == ["depth", "flow", "height"]


def test_missing_values_in_conditions(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,)], "x double")
    keep = lambda condition: sorted(str(r["x"]) for r in wrangle.filter_rows(df, condition).collect())
    assert keep("x != 5") == ["1.0"] and keep("NOT (x > 3)") == ["1.0"]
    assert keep(wrangle.compare("x", "!=", 5)) == ["1.0", "None"]
    assert keep(~wrangle.compare("x", ">", 3)) == ["1.0", "None"]
    assert keep(wrangle.compare("x", ">", 3)) == ["5.0"]
    assert keep(wrangle.compare("x", "==", 5) | wrangle.compare("x", "<", 2)) == ["1.0", "5.0"]
    with pytest.raises(ValueError):
        wrangle.compare("x", "~", 1)


def test_mutate_is_sequential(spark):
    df = spark.createDataFrame([(2.0,)], "a double")
    out = wrangle.mutate(df, {"b": "a * 2", "a": "a + b", "`c d`": "1"} | {"c": "a + b"})
    assert wrangle.created_columns(df, {"b": "a", "a": "a"}) == ["b"]
    assert out.first().asDict()["a"] == 6.0 and out.first().asDict()["c"] == 10.0


def test_mutate_with_summaries(spark, sliced):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,)], "v double")
    out = wrangle.mutate_with_summaries(df, {"m": ("v", "median")}, {"v": "coalesce(v, m)"})
    assert sorted(r["v"] for r in out.collect()) == [1.0, 2.0, 2.0, 9.0] and out.columns == ["v"]


def test_impute(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a"), (2, 2.0, "b"), (3, 300.0, "b"), (None, None, None), (2, 2.0, "a")],
        "even int, skewed double, word string",
    )
    filled = wrangle.impute(df, ["even", "skewed", "word"]).collect()
    assert [r["even"] for r in filled] == [1.0, 2.0, 3.0, 2.0, 2.0]  # symmetric: mean
    assert filled[3]["skewed"] == 2.0  # skewed: median
    assert filled[3]["word"] == "a"  # ties go to the smallest
    with pytest.raises(TypeError):
        wrangle.impute(df, ["word"], "mean")
    nothing = spark.createDataFrame([(None,)], "v double")
    assert wrangle.impute(nothing, ["v"]).first()["v"] is None


@pytest.mark.parametrize("kind", ["TIMESTAMP_NTZ", "TIMESTAMP", "DATE"])
def test_times_in_another_zone(spark, kind):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = f"SELECT k, CAST(v AS {kind}) AS v FROM VALUES ('a', '2024-03-01 10:00:00.123456'), "
        times += "('a', '2024-03-01 10:00:00.123456'), ('b', '2024-07-01'), ('b', NULL) t(k, v)"
        df = spark.sql(times)
        filled = wrangle.impute(df, ["v"], "mode")
        assert filled.filter(f"v = CAST('2024-03-01 10:00:00.123456' AS {kind})").count() == 3
        cells = describe.contingency_counts(df, "k", "v")
        assert cells.count() == 6 and cells.agg({"count": "sum"}).first()[0] == 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_awkward_names(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "`a.b c` double, `x``y` double")
    assert wrangle.drop_missing_rows(df, ["a.b c"]).count() == 1
    assert wrangle.impute(df, ["a.b c", "x`y"], "mean").filter("`a.b c` IS NULL").count() == 0
    assert wrangle.filter_rows(df, wrangle.compare("a.b c", ">", 0)).count() == 1


def test_row_counts_and_duplicates(spark, sites):
    counted = wrangle.row_counts(sites, sites.filter("depth >= 40")).first()
    assert tuple(counted) == (130, 50, 80)  # depths are 0 to 64.5 in halves
    maps = spark.sql("SELECT map('a', id % 2) AS m, id % 2 AS k FROM range(6)")
    assert wrangle.drop_duplicate_rows(maps).count() == 2
    twice = sites.unionAll(sites)
    assert wrangle.drop_duplicate_rows(twice).count() == 130


def test_filter_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = wrangle.select_columns(wrangle.filter_rows(events, "value > 50"), ["event_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,50.0)" in text and "event_type" not in text


def test_summary_names_must_be_new(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError, match="already"):
        wrangle.mutate_with_summaries(df, {"v": ("v", "mean")}, {"w": "v"})
