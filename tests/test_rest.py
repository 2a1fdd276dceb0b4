import pytest
from helpers import SF_DIR, by, rows
from data import patients_file
from pyspark.sql import functions as F

from plumbline.catalog.datasets import DatasetCatalog, UnknownDataset, latest_by_key, lineage
from plumbline.catalog.runs import (
    RunHistory, compare_p_values, compare_runs, highlights, recent_runs, run_type, runs_for_dataset,
)
from plumbline.operators import advisories, charts, clean, profile
from plumbline.operators.readiness import quality_report
from plumbline.session import new_folder
from plumbline.sources.files import IngestionError, flatten, infer_types, read_csv, read_csv_texts, read_json

# ---- sources --------------------------------------------------------------------


def test_types_of_a_file(spark, tmp_path):
    df = read_csv(spark, patients_file(tmp_path))
    assert df.count() == 700 and dict(df.dtypes) == {
        "Visits": "bigint", "Glucose": "bigint", "Insulin (mU)": "double", "Income": "double",
        "Outcome": "string",  # six letters O among the digits
        "City": "string",
    }
    found = by(advisories.type_consistency(df), "column")["Outcome"]
    assert found["numeric_pct"] == pytest.approx(694 / 700)
    assert rows(advisories.inconsistent_values(df, "Outcome")) == [{"value": "O", "count": 6}]


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_cells_that_mean_missing(spark, tmp_path):
    path = write(
        tmp_path, "t.csv",
        'i,f,b,s,e,big,d\n1,1.5,True,x,,9223372036854775808,2024-01-01\n'
        'NA,nan,FALSE,None,N/A,1,2024-01-02\n 3,-2e3,true,"a, ""b""",,2,x\n',
    )
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "e": "double", "big": "double", "d": "string",
    }
    found = df.collect()
    assert [r["i"] for r in found] == [1, None, 3] and [r["f"] for r in found] == [1.5, None, -2000.0]
    assert found[2]["s"] == 'a, "b"' and found[1]["s"] is None


def test_java_number_suffixes_stay_texts(spark, tmp_path):
    assert infer_types(read_csv_texts(spark, write(tmp_path, "t.csv", "v\n1d\n2f\n"))) == {"v": "string"}


def test_missing_file(spark):
    with pytest.raises(IngestionError):
        read_csv(spark, "/tmp/there-is-no-such-file.csv")


def test_json(spark, tmp_path):
    path = write(tmp_path, "t.json", '{"rows": [{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": {"c": null}}]}')
    df = read_json(spark, path, records="rows", multiline=True)
    assert df.columns == ["a", "b.c"] and df.count() == 2
    assert flatten(spark.sql("SELECT struct(struct(1 AS `x.y`) AS b) AS a")).columns == ["a.b.x.y"]


def test_profile_of_a_file(spark, tmp_path):
    found = by(profile.ingest_profile(read_csv(spark, patients_file(tmp_path))), "column")
    assert found["Visits"]["example_values"] == ["0", "1", "2", "3", "4"]
    assert found["City"]["example_values"] == ["La Paz", "Lima", "Quito"]
    assert found["City"]["semantic_type"] == "categorical"
    assert found["Visits"]["semantic_type"] == "numeric_categorical"


# ---- charts ----------------------------------------------------------------------


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]] + [(None,)], "v double")
    found = rows(charts.histogram(df, "v", 5), "bin")
    assert [r["count"] for r in found] == [2, 2, 0, 0, 1]  # the last bin is closed
    flat = charts.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()
    assert [(r["lower"], r["upper"], r["count"]) for r in flat] == [(2.0, 2.0, 2)]
    for bins in (0, 101):
        with pytest.raises(ValueError):
            charts.histogram(df, "v", bins)


def test_box_and_comparison(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]] + [(None,)], "v double")
    box = charts.box_stats(df, "v").first()
    assert (box["whisker_low"], box["whisker_high"], box["n_fliers"]) == (1.0, 5.0, 1)
    compared = charts.outlier_comparison(df, "v").first()
    assert (compared["total_values"], compared["outliers_removed"], compared["clean_values"]) == (6, 1, 5)
    sides = by(charts.comparison_chart(df, "v"), "side")
    assert sides["with_outliers"]["n"] == 6 and sides["without_outliers"]["n"] == 5
    with pytest.raises(TypeError):
        charts.outlier_comparison(spark.createDataFrame([("A",)], "category string"), "category")


def test_missing_categories(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", 3.0)], "`k.x` string, v double")
    assert rows(charts.bar_counts(df, "k.x")) == [{"k.x": "a", "count": 2}]
    assert charts.bar_means(df, "k.x", "v").first()["mean"] == 2.0
    assert {r["is_missing"] for r in charts.composition(df, "k.x").collect()} == {True, False}
    assert rows(charts.line_means(df, "v", "v"))[0] == {"x": 1.0, "n": 1, "mean": 1.0}


def test_charts_by_name(spark):
    df = spark.createDataFrame([("a", 1.0, "u"), ("b", 2.0, "u"), ("a", 4.0, "v")], "k string, v double, h string")
    shapes = {
        ("Hist", "v", None, None): 10, ("box_plot", "k", "v", None): 2, ("box", "v", None, None): 1,
        ("boxplot", "k", "v", "h"): 3, ("scatter-plot", "v", "v", "h"): 3, ("Bar Chart", "k", None, None): 2,
        ("bar", "k", "v", "h"): 3, ("line", "v", "v", None): 3, ("PIE", "h", None, None): 2,
    }
    for (kind, x, y, hue), n in shapes.items():
        assert charts.chart_table(df, kind, x, y, hue).count() == n, kind
    for kind, y in (("scatter", None), ("line", None), ("radar", "v")):
        with pytest.raises(ValueError):
            charts.chart_table(df, kind, "v", y)


def test_recommendations(spark):
    found = rows(charts.chart_recommendations(spark.read.parquet(f"{SF_DIR}/events.parquet")))
    assert 4 <= len(found) <= 7 and {"histogram", "box", "scatter", "line"} <= {r["chart"] for r in found}


# ---- catalog ---------------------------------------------------------------------


def test_datasets_and_lineage(spark):
    catalog = DatasetCatalog(spark, new_folder(spark, "catalog"))
    assert catalog.datasets().count() == 0
    df = spark.createDataFrame([(1, "fir"), (2, "oak")], "id int, tree string")
    root = catalog.save(df, "trees.csv")
    child = catalog.save(df.filter("id > 1"), "filtered", parent_dataset_id=root, transformation_note="id > 1")
    leaf = catalog.save(df.select("id"), "selected", parent_dataset_id=child)
    assert root.startswith("ds_") and catalog.has(leaf) and not catalog.has("ds_none")
    assert [r["dataset_id"] for r in catalog.lineage(leaf).collect()] == [leaf, child, root]
    row = catalog.metadata(root).first()
    assert (row["n_rows"], row["n_columns"], row["columns"]) == (2, 2, ["id", "tree"])
    assert row["column_types"] == {"id": "int", "tree": "string"}
    assert [r["dataset_id"] for r in catalog.list_datasets().collect()] == [leaf, child, root]
    catalog.save(df.union(df), "again.csv", dataset_id=root)  # the newest listing counts
    assert catalog.load(root).count() == 4 and catalog.datasets().count() == 3
    with pytest.raises(UnknownDataset):
        catalog.load("ds_none")


def test_session_datasets(spark):
    catalog = DatasetCatalog(spark, new_folder(spark, "catalog"))
    saved = catalog.save(spark.range(3).toDF("a"), "three")
    here = catalog.register(spark.range(5).toDF("a"))
    assert catalog.get(here).count() == 5 and catalog.get(saved).count() == 3
    assert {r["dataset_id"]: r["in_memory"] for r in catalog.listing().collect()} == {here: True, saved: False}
    catalog.clear()
    with pytest.raises(UnknownDataset):
        catalog.get(here)


def test_lineage_through_the_session(spark):
    catalog = DatasetCatalog(spark, new_folder(spark, "catalog"))
    root = catalog.save(spark.range(9).toDF("a"), "nine")
    step = catalog.register(spark.range(4).toDF("a"), filename="four", parent_dataset_id=root, transformation_note="a < 4")
    leaf = catalog.save(spark.range(2).toDF("a"), "two", parent_dataset_id=step)
    chain = [(r["dataset_id"], r["transformation_note"], r["n_rows"]) for r in catalog.lineage(leaf).collect()]
    assert chain == [(leaf, None, 2), (step, "a < 4", 4), (root, None, 9)]
    catalog.clear()
    assert [r["dataset_id"] for r in catalog.lineage(leaf).collect()] == [leaf]


def test_lineage_ends_and_cycles(spark):
    df = spark.createDataFrame([("a", "gone"), ("x", "y"), ("y", "x")], "dataset_id string, parent_dataset_id string")
    assert [r["dataset_id"] for r in lineage(df, "a").collect()] == ["a"]
    assert lineage(df, "nothing").count() == 0
    with pytest.raises(Exception, match="cycle"):
        lineage(df, "x").collect()


def test_long_lineage(spark):
    df = spark.range(150).selectExpr(
        "concat('d', id) AS dataset_id", "IF(id > 0, concat('d', id - 1), NULL) AS parent_dataset_id"
    )
    assert lineage(df, "d149").count() == 150


def test_runs(spark):
    history = RunHistory(spark, new_folder(spark, "history"))
    assert history.runs().count() == 0
    a = history.save("ds_1", "first?", "inference", readiness_overall=61.5, p_values={"t_test": 0.08, "z": 0.2})
    b = history.save("ds_1", "second?", "nonsense", readiness_overall=92.0, p_values={"t_test": 0.03})
    runs = history.runs()
    assert by(runs, "run_id")[b]["run_type"] == "full"
    compared = compare_runs(runs, a, b).first()
    assert compared["readiness_delta"] == 30.5 and compared["same_dataset"]
    tests = by(compare_p_values(runs, a, b), "test")
    assert tests["t_test"]["delta"] == pytest.approx(-0.05) and tests["z"]["p_b"] is None
    assert compared["created_a"] < compared["created_b"]
    assert compare_runs(runs, a, "run_none").count() == 0
    told = history.save("ds_3", "q", highlights=highlights(True, 4))
    assert by(history.runs(), "run_id")[told]["highlights"] == {"has_correlations": "true", "n_columns_described": "4"}
    for i in range(3):
        history.save("ds_2", f"q{i}")
    assert len(runs_for_dataset(history.runs(), "ds_2", 2).collect()) == 2
    assert [r["user_question"] for r in recent_runs(history.runs(), 3).collect()] == ["q2", "q1", "q0"]
    with pytest.raises(ValueError):
        history.save("ds_1", "q", mood="good")


@pytest.mark.parametrize("flags, expected", [
    ((False, False, True), "quality_check"), ((False, True, True), "descriptive"),
    ((True, False, False), "inference"), ((True, True, False), "full"), ((True, False, True), "full"),
])
def test_run_types(spark, flags, expected):
    row = spark.range(1).select(run_type(*[F.lit(f) for f in flags])).first()
    assert row[0] == expected


def test_latest_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, at int, v string")
    assert {r["k"]: r["v"] for r in latest_by_key(df, "k", ["at"]).collect()} == {"a": "y", "b": "z"}


# ---- cleaning and hints ------------------------------------------------------------


def test_clean_frame_is_left_alone(spark):
    df = spark.range(200).selectExpr("id", "CAST(id * 2 AS DOUBLE) AS v")
    cleaned, steps = clean.auto_clean(df)
    assert steps.count() == 0 and cleaned.count() == 200


def test_rules_stop_in_time(spark):
    df = spark.createDataFrame([(None, None)] * 5, "a double, b double")
    cleaned, steps = clean.auto_clean(df)
    assert [r["rule"] for r in steps.collect()] == ["drop_duplicates"] and cleaned.columns == ["a", "b"]
    df = spark.range(100).selectExpr("id", "IF(id < 35, NULL, id % 7) AS gap", "1 AS one")
    cleaned, steps = clean.auto_clean(df, max_iterations=1)
    assert [(r["rule"], r["columns"]) for r in steps.collect()] == [("drop_constant_columns", "one")]


def test_hints(spark):
    df = spark.range(100).selectExpr(
        "id", "CAST(uuid() AS STRING) AS token", "id % 2 AS y", "IF(id < 80, 'p', 'n') AS target",
        "(id % 2) * 3.0 + 1 AS leak",
    )
    ids = by(advisories.id_like_columns(df), "column")
    assert ids["id"]["is_sequential"] and ids["token"]["is_uuid"] and not ids["y"]["is_id_like"]
    balance = by(advisories.class_balance(df, "target"), "class")
    assert balance["p"]["share"] == 0.8 and balance["p"]["is_imbalanced"]
    assert balance["n"]["entropy"] == pytest.approx(0.5004024235381879)
    assert [r["column"] for r in advisories.leakage_hints(df, "y").collect()] == ["leak"]
    sampled = advisories.stratified_sample(df, "target", {"p": 0.0, "n": 1.0}).collect()
    assert len(sampled) == 20 and {r["target"] for r in sampled} == {"n"}


def test_missing_patterns(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (float("nan"), "x")], "a double, b string")
    assert {r["pattern"]: r["n_rows"] for r in advisories.missing_patterns(df).collect()} == {"11": 1, "01": 1, "10": 1}
    assert {r["n_missing"]: r["n_rows"] for r in advisories.row_missingness(df).collect()} == {2: 1, 1: 2}


# ---- entry points and plans ----------------------------------------------------------


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """No nested-loop joins, no Cartesian products, no windows over a whole frame."""
    from checks import all_checks

    for name in ("contingency_expected", "category_counts", "box_stats_by_group", "orphan_runs",
                 "compare_p_values", "latest_by_key", "correlation_matrix", "missing_profile"):
        text = plan(all_checks()[name].run(spark, SF_DIR))
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name
        assert "SinglePartition, ENSURE_REQUIREMENTS, [plan_id" not in text or "Window" not in text, name


def test_filters_reach_the_scan(spark):
    from plumbline.operators import outliers, wrangle

    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    metadata = outliers.outlier_metadata(events, ["value"], "iqr")
    pushed = lambda df: plan(df).split("PushedFilters: [")[1].split("]")[0]
    assert "LessThanOrEqual(value" in pushed(outliers.remove_outliers(events, metadata, ["value"]))
    assert "LessThan(value" in pushed(outliers.outlier_rows(events, "value", "iqr"))
    assert "IsNotNull(value)" in pushed(wrangle.drop_missing_rows(events, ["value"]))


def test_profile_reads_only_its_columns(spark):
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    text = plan(profile.missing_profile(lines, ["l_tax"]))
    assert "l_extendedprice" not in text.split("ReadSchema")[1]


def test_report_per_batch_of_a_stream(spark, tmp_path):
    """Operators are functions of a frame, so a stream can apply them batch by batch."""
    source = str(tmp_path / "events")
    spark.read.parquet(f"{SF_DIR}/events.parquet").repartition(2).write.parquet(source)
    scores = []

    def score(batch, _):
        scores.append(quality_report(batch).dataset.first()["n_rows"])

    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    query = (
        stream.option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(score)
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert len(scores) == 2 and sum(scores) == spark.read.parquet(source).count()
