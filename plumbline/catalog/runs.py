"""The history of analysis runs: saved, found again, compared."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.datasets import latest_by_key

RUN_SCHEMA = (
    "run_id string, dataset_id string, user_question string, run_type string, summary string,"
    " p_values map<string,double>, confidence_intervals map<string,array<double>>,"
    " effect_sizes map<string,double>, highlights map<string,string>, plot_paths array<string>,"
    " readiness_overall double, created_at timestamp, session_id string"
)
# Fixed values.
RUN_TYPES = ["full", "quality_check", "descriptive", "inference"]
QUESTION_PREVIEW = 100
SUMMARY_PREVIEW = 500


def run_type(has_inference: Column, has_describe: Column, has_viz: Column) -> Column:
    """The type of a run from which outputs it has."""
    return (
        F.when(~has_inference & ~has_describe, "quality_check")
        .when(~has_inference, "descriptive")
        .when(~has_describe & ~has_viz, "inference")
        .otherwise("full")
    )


def structured_results(tests: DataFrame, by: list[str]) -> DataFrame:
    """``by, p_values, confidence_intervals, effect_sizes`` from test rows.

    ``tests`` has ``by, test_type, p_value, ci_low, ci_high, cohen_d``, one row per test of
    a run, so each collected list is as long as the run has tests. A test that occurs
    twice keeps its largest entry.
    """
    once = tests.groupBy(*by, "test_type").agg(
        F.max(F.struct("p_value", "ci_low", "ci_high", "cohen_d")).alias("t")
    )

    def as_map(value: Column, known: Column) -> Column:
        entries = F.collect_list(F.when(known, F.struct(F.col("test_type"), value)))
        return F.map_from_entries(F.array_sort(entries))

    return once.groupBy(*by).agg(
        as_map(F.col("t.p_value"), F.col("t.p_value").isNotNull()).alias("p_values"),
        as_map(F.array("t.ci_low", "t.ci_high"), F.col("t.ci_low").isNotNull()).alias(
            "confidence_intervals"
        ),
        as_map(F.col("t.cohen_d"), F.col("t.cohen_d").isNotNull()).alias("effect_sizes"),
    )


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs. Spark keeps the top ones per task."""
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)


def runs_for_dataset(runs: DataFrame, dataset_id: str, limit: int = 10) -> DataFrame:
    return recent_runs(runs.filter(F.col("dataset_id") == dataset_id), limit)


def run_summaries(runs: DataFrame) -> DataFrame:
    """What a list of runs shows: a preview of the question, the score, whether a summary exists."""
    question = F.col("user_question")
    long = F.length(question) > QUESTION_PREVIEW
    return runs.select(
        "run_id", "dataset_id", "run_type",
        F.concat(
            F.substring(question, 1, QUESTION_PREVIEW), F.when(long, "...").otherwise("")
        ).alias("user_question"),
        "readiness_overall", "created_at",
        (F.coalesce(F.length("summary"), F.lit(0)) > 0).alias("has_summary"),
    )


def compare_p_values(runs: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """``test, p_a, p_b, delta`` for every test of either run."""

    def exploded(run_id: str, name: str) -> DataFrame:
        return get_run(runs, run_id).select(F.explode("p_values").alias("test", name))

    joined = exploded(run_a, "p_a").join(exploded(run_b, "p_b"), "test", "full_outer")
    return joined.select("test", "p_a", "p_b", (F.col("p_b") - F.col("p_a")).alias("delta"))


def compare_runs(runs: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """One row about two runs, or none when either is missing.

    ``run_a, run_b, created_a, created_b, same_dataset, readiness_delta`` (b minus a) and
    the start of both summaries. One scan finds both; of several rows of one run the
    newest counts. :func:`compare_p_values` has the tests.
    """
    shown = F.struct(
        "created_at", "dataset_id", "readiness_overall",
        F.substring(F.coalesce("summary", F.lit("")), 1, SUMMARY_PREVIEW).alias("summary"),
    )
    sides = {"a": run_a, "b": run_b}
    newest = [F.max(F.when(F.col("run_id") == run, shown)).alias(tag) for tag, run in sides.items()]
    found = runs.filter(F.col("run_id").isin(run_a, run_b)).agg(*newest).filter("a IS NOT NULL AND b IS NOT NULL")
    return found.select(
        F.lit(run_a).alias("run_a"),
        F.lit(run_b).alias("run_b"),
        F.col("a.created_at").alias("created_a"),
        F.col("b.created_at").alias("created_b"),
        F.col("a.dataset_id").eqNullSafe(F.col("b.dataset_id")).alias("same_dataset"),
        (F.col("b.readiness_overall") - F.col("a.readiness_overall")).alias("readiness_delta"),
        F.col("a.summary").alias("summary_a"),
        F.col("b.summary").alias("summary_b"),
    )


def highlights(has_correlations: bool, n_columns_described: int | None = None) -> dict[str, str]:
    """What a run's ``highlights`` say about its description."""
    found = {"has_correlations": "true"} if has_correlations else {}
    return found | ({} if n_columns_described is None else {"n_columns_described": str(n_columns_described)})


def orphan_runs(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Runs of datasets that the catalog does not list."""
    return runs.join(datasets.select("dataset_id"), "dataset_id", "left_anti")


class RunHistory:
    """Runs appended to one Parquet table; the newest row of a run id counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/analysis_runs"

    def save(self, dataset_id: str, user_question: str, run_type: str = "full", **fields) -> str:
        """Append one run. An unknown ``run_type`` is stored as "full"."""
        names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
        unknown = set(fields) - set(names)
        if unknown:
            raise ValueError(f"a run has no fields {sorted(unknown)}")
        run = {
            "run_id": f"run_{uuid.uuid4().hex[:12]}",
            "created_at": datetime.now(timezone.utc),
            "summary": "",
            "p_values": {}, "confidence_intervals": {}, "effect_sizes": {}, "highlights": {},
            "plot_paths": [],
            **fields,
            "dataset_id": dataset_id,
            "user_question": user_question,
            "run_type": run_type if run_type in RUN_TYPES else "full",
        }
        row = self.spark.createDataFrame([tuple(run.get(n) for n in names)], RUN_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(self.path)
        return run["run_id"]

    def append(self, runs: DataFrame) -> None:
        """Append many runs at once."""
        names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
        runs.select(*names).write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        try:
            saved = self.spark.read.schema(RUN_SCHEMA).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return latest_by_key(saved, "run_id", ["created_at"])
