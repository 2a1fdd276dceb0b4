"""Times the headline operators and prints one JSON line.

The given tables are one file each, which one task would read. They are dealt over as
many files as there are cores first, as large tables are; that is not timed.

Each operator runs once cold and three times warm. Operators that give a frame are
forced with a ``noop`` write; those that give a report write all its parts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.cleaning import dirty  # noqa: E402
from plumbline.operators import charts, clean, describe, inference, outliers, profile, readiness  # noqa: E402
from plumbline.session import get_session, new_folder  # noqa: E402

WARM_RUNS = 3


def force(*frames):
    for frame in frames:
        frame.write.format("noop").mode("overwrite").save()


def dealt(spark, folder, cpus):
    """A folder with the tables of the bench, each in ``cpus`` files."""
    copy = new_folder(spark, "bench")
    for name in ("lineitem", "orders", "documents", "labels", "events"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(cpus).write.parquet(f"{copy}/{name}.parquet")
    return copy


def headline(spark, folder):
    def read(name):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    def quality(name, exact=True):
        report = readiness.quality_report(read(name), exact=exact)
        force(report.columns, report.outliers, report.dataset)

    return {
        "quality_report": lambda: quality("lineitem"),
        "quality_report_approx": lambda: quality("lineitem", exact=False),
        "univariate": lambda: force(describe.univariate_numeric(read("lineitem"))),
        "correlation_matrix": lambda: force(describe.correlation_matrix(read("lineitem"))),
        "contingency_expected": lambda: force(
            describe.contingency_expected(read("orders"), "o_orderstatus", "o_orderpriority")
        ),
        "group_summary": lambda: force(
            describe.group_summary(read("lineitem"), "l_extendedprice", "l_returnflag")
        ),
        "clt_sampling": lambda: force(
            inference.sampling_distribution(read("lineitem"), "l_extendedprice", 30, 1000)
        ),
        "two_sample_t_test": lambda: force(
            inference.two_sample_test(read("lineitem"), "l_quantity", "l_returnflag", "A", "R")
        ),
        "auto_clean": lambda: force(*clean.auto_clean(dirty(spark, folder))),
        "histogram_and_box": lambda: force(
            charts.histogram(read("events"), "value"), charts.box_stats(read("events"), "value")
        ),
        "outlier_rows": lambda: force(outliers.outlier_rows(read("events"), "value")),
        "duplicate_texts": lambda: force(profile.duplicate_rows(read("documents").select("text"))),
    }


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm, cold = {}, {}
    only = set(sys.argv[1:])
    for name, run in headline(spark, dealt(spark, folder, int(cpus))).items():
        if only and name not in only:
            continue
        seconds = []
        for _ in range(1 + WARM_RUNS):
            start = time.perf_counter()
            run()
            seconds.append(time.perf_counter() - start)
        cold[name] = round(seconds[0], 3)
        warm[name] = round(statistics.median(seconds[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "sum of warm medians",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
