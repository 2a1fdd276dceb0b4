"""Dataset listing, lineage and run history, over catalogs derived from the tables.

Conversations give a catalog with lineage: each turn is a dataset made from the turn before.
Documents give a run history: each document is a run on the dataset of its source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Checks, normal_p_sql, rounded, table
from plumbline.catalog import datasets as ds
from plumbline.catalog import runs as rn
from plumbline.operators import inference
from plumbline.session import new_folder

CHECKS = Checks()


def datasets(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('ds_', conv_id, '_', turn) AS dataset_id",
        "role AS transformation_note",
        "IF(turn > 0, concat('ds_', conv_id, '_', turn - 1), NULL) AS parent_dataset_id",
        "CAST(length(text) AS BIGINT) AS n_rows",
        "4L AS n_columns",
        "array('conv_id', 'turn', 'role', 'text') AS columns",
        "timestampadd(MINUTE, CAST(conv_id * 10 + turn AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ingested_at",
        "conv_id", "turn",
    )


DATASETS = """(SELECT 'ds_' || conv_id || '_' || turn AS dataset_id, role AS transformation_note,
    CASE WHEN turn > 0 THEN 'ds_' || conv_id || '_' || (turn - 1) END AS parent_dataset_id,
    length(text) AS n_rows, 4::BIGINT AS n_columns,
    TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 10 + turn) * INTERVAL 1 MINUTE AS ingested_at,
    conv_id, turn FROM conversations)"""


def runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('run_', doc_id) AS run_id",
        "concat('ds_', source) AS dataset_id",
        "text AS user_question",
        "IF(lang = 'en', text, '') AS summary",
        "IF(lang = 'en', 'full', 'descriptive') AS run_type",
        "least(100D, n_chars / 100D) AS readiness_overall",
        "map(concat('t_', lang), 1D / (1 + n_chars), 'z', 1D / (2 + n_chars)) AS p_values",
        "timestampadd(MINUTE, CAST(doc_id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS created_at",
    )


RUNS = """(SELECT 'run_' || doc_id AS run_id, 'ds_' || source AS dataset_id, text AS user_question,
    CASE WHEN lang = 'en' THEN text ELSE '' END AS summary,
    CASE WHEN lang = 'en' THEN 'full' ELSE 'descriptive' END AS run_type,
    least(100.0::DOUBLE, n_chars / 100.0::DOUBLE) AS readiness_overall, lang, n_chars, doc_id,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS created_at FROM documents)"""


def minutes(df, *names):
    """Times as texts, the same in both engines."""
    for name in names:
        df = df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm"))
    return df


@CHECKS.add(
    "catalog_merge_list",
    f"""SELECT dataset_id, n_rows, n_columns, 'conv_id, turn, role, text' AS columns,
               turn = 0 AS in_memory FROM {DATASETS}""",
)
def catalog_merge_list(spark, sf_dir):
    """The session holds the first turns; the saved listing holds all."""
    saved = datasets(spark, sf_dir)
    listed = ds.merge_listing(saved.filter("turn = 0"), saved)
    return listed.withColumn("columns", F.array_join("columns", ", "))


@CHECKS.add(
    "list_datasets",
    f"""SELECT dataset_id, n_rows, strftime(ingested_at, '%Y-%m-%d %H:%M') AS ingested_at FROM {DATASETS}""",
)
def list_datasets(spark, sf_dir):
    listed = ds.newest_first(datasets(spark, sf_dir))
    return minutes(listed.select("dataset_id", "n_rows", "ingested_at"), "ingested_at")


@CHECKS.add(
    "lineage_chain",
    f"""WITH RECURSIVE d AS (SELECT * FROM {DATASETS}),
        leaf AS (SELECT dataset_id FROM d ORDER BY turn DESC, conv_id LIMIT 1),
        chain AS (SELECT d.*, 0 AS depth FROM d JOIN leaf ON d.dataset_id = leaf.dataset_id
                  UNION ALL SELECT d.*, c.depth + 1 FROM chain c JOIN d ON d.dataset_id = c.parent_dataset_id)
        SELECT dataset_id, depth, transformation_note, n_rows FROM chain""",
)
def lineage_chain(spark, sf_dir):
    """The longest chain, from the newest dataset to its root."""
    listed = datasets(spark, sf_dir)
    leaf = listed.orderBy(F.col("turn").desc(), "conv_id").select("dataset_id").first()[0]
    return ds.lineage(listed, leaf).select("dataset_id", "depth", "transformation_note", "n_rows")


# Some turns lead back to the last one of their conversation, some to a conversation that is not there.
LOOPS = """(SELECT 'ds_' || conv_id || '_' || turn AS dataset_id,
        CASE WHEN turn = 0 AND conv_id % 7 = 3 THEN 'ds_' || conv_id || '_1' WHEN turn = 0 AND conv_id % 7 = 4 THEN 'gone'
             WHEN turn > 0 THEN 'ds_' || conv_id || '_' || (turn - 1) END AS parent, conv_id, turn FROM conversations)"""


@CHECKS.add(
    "all_lineage",
    f"""SELECT dataset_id, CASE WHEN conv_id % 7 <> 3 THEN 'ds_' || conv_id || '_0' END AS root_id,
               CASE WHEN conv_id % 7 <> 3 THEN turn END AS depth,
               CASE conv_id % 7 WHEN 3 THEN 'cycle' WHEN 4 THEN 'unlisted' ELSE 'root' END AS ends FROM {LOOPS}""",
)
def all_lineage(spark, sf_dir):
    """Every turn's chain; some end in a cycle or at a dataset that is not listed."""
    parent = """CASE WHEN turn = 0 AND conv_id % 7 = 3 THEN concat('ds_', conv_id, '_1') WHEN turn = 0 AND conv_id % 7 = 4 THEN 'gone'
        ELSE parent_dataset_id END"""
    return ds.all_lineage(datasets(spark, sf_dir).withColumn("parent_dataset_id", F.expr(parent)))


@CHECKS.add(
    "latest_by_key",
    """SELECT user_id, event_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_by_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return ds.latest_by_key(events, "user_id", ["ts", "event_id"]).drop("ts")


SUMMARY = """run_id, dataset_id, run_type,
    substr(user_question, 1, 100) || CASE WHEN length(user_question) > 100 THEN '...' ELSE '' END AS user_question,
    round(readiness_overall, 6) AS readiness_overall, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at,
    length(summary) > 0 AS has_summary"""


@CHECKS.add("recent_runs", f"SELECT {SUMMARY} FROM {RUNS} ORDER BY doc_id DESC LIMIT 20")
def recent_runs(spark, sf_dir):
    return rounded(minutes(rn.run_summaries(rn.recent_runs(runs(spark, sf_dir))), "created_at"))


@CHECKS.add("run_summaries", f"SELECT {SUMMARY} FROM {RUNS}")
def run_summaries(spark, sf_dir):
    return rounded(minutes(rn.run_summaries(runs(spark, sf_dir)), "created_at"))


@CHECKS.add(
    "runs_for_dataset",
    f"SELECT {SUMMARY} FROM {RUNS} WHERE dataset_id = 'ds_src3' ORDER BY doc_id DESC LIMIT 10",
)
def runs_for_dataset(spark, sf_dir):
    found = rn.runs_for_dataset(runs(spark, sf_dir), "ds_src3")
    return rounded(minutes(rn.run_summaries(found), "created_at"))


@CHECKS.add(
    "get_run",
    f"""SELECT run_id, dataset_id, run_type, user_question, summary,
               round(readiness_overall, 6) AS readiness_overall FROM {RUNS} WHERE run_id = 'run_17'""",
)
def get_run(spark, sf_dir):
    found = rn.get_run(runs(spark, sf_dir), "run_17")
    return rounded(
        found.select("run_id", "dataset_id", "run_type", "user_question", "summary", "readiness_overall")
    )


@CHECKS.add(
    "compare_runs",
    f"""SELECT a.run_id AS run_a, b.run_id AS run_b, a.dataset_id = b.dataset_id AS same_dataset,
               strftime(a.created_at, '%Y-%m-%d %H:%M') AS created_a, strftime(b.created_at, '%Y-%m-%d %H:%M') AS created_b,
               round(b.readiness_overall - a.readiness_overall, 6) AS readiness_delta,
               substr(a.summary, 1, 500) AS summary_a, substr(b.summary, 1, 500) AS summary_b
        FROM {RUNS} a, {RUNS} b WHERE a.run_id = 'run_3' AND b.run_id = 'run_17'""",
)
def compare_runs(spark, sf_dir):
    return rounded(minutes(rn.compare_runs(runs(spark, sf_dir), "run_3", "run_17"), "created_a", "created_b"))


TESTS = f"""(SELECT run_id, 't_' || lang AS test, 1.0::DOUBLE / (1 + n_chars) AS p FROM {RUNS}
             UNION ALL SELECT run_id, 'z', 1.0::DOUBLE / (2 + n_chars) FROM {RUNS})"""


@CHECKS.add(
    "compare_p_values",
    f"""SELECT coalesce(a.test, b.test) AS test, round(a.p, 8) AS p_a, round(b.p, 8) AS p_b,
               round(b.p - a.p, 8) AS delta
        FROM (SELECT * FROM {TESTS} WHERE run_id = 'run_3') a
        FULL JOIN (SELECT * FROM {TESTS} WHERE run_id = 'run_17') b ON a.test = b.test""",
)
def compare_p_values(spark, sf_dir):
    return rounded(rn.compare_p_values(runs(spark, sf_dir), "run_3", "run_17"), 8)


@CHECKS.add(
    "orphan_runs",
    """SELECT 'run_' || doc_id AS run_id, doc_id::VARCHAR AS dataset_id FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def orphan_runs(spark, sf_dir):
    """Documents without labels as runs whose dataset is not listed."""
    history = table(spark, sf_dir, "documents").selectExpr(
        "concat('run_', doc_id) AS run_id", "CAST(doc_id AS STRING) AS dataset_id"
    )
    listed = table(spark, sf_dir, "labels").selectExpr("CAST(doc_id AS STRING) AS dataset_id")
    return rn.orphan_runs(history, listed)


@CHECKS.add(
    "run_type",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_totalprice <= 250000 THEN 'quality_check'
            WHEN o_orderstatus <> 'F' THEN 'descriptive'
            WHEN o_totalprice <= 250000 AND o_orderpriority <> '1-URGENT' THEN 'inference'
            ELSE 'full' END AS run_type FROM orders""",
)
def run_type(spark, sf_dir):
    """Three properties of an order stand for the outputs of a run."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        rn.run_type(
            F.col("o_orderstatus") == "F", F.col("o_totalprice") > 250000,
            F.col("o_orderpriority") == "1-URGENT",
        ).alias("run_type"),
    )


STATS = """SELECT event_type, (avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))) AS statistic,
    (avg(value) - 50) / stddev_samp(value) AS d,
    avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(*)) AS lo,
    avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(*)) AS hi FROM events GROUP BY event_type"""


@CHECKS.add(
    "structured_results",
    f"""SELECT event_type, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(p_value, 6) AS p_value,
               round(d, 6) AS effect_size, 1::INT AS n_tests
        FROM ({STATS}) JOIN ({normal_p_sql(f"SELECT event_type, statistic FROM ({STATS})", "event_type")}) USING (event_type)""",
)
def structured_results(spark, sf_dir):
    """A z test per event type, gathered into the maps of a run record."""
    tests = inference.one_sample_test(
        table(spark, sf_dir, "events"), "value", "z", mu=50.0, by=["event_type"]
    ).withColumn("cohen_d", F.expr("(mean - hypothesized_mean) / std"))
    found = rn.structured_results(tests, ["event_type"])
    return rounded(
        found.selectExpr(
            "event_type",
            "confidence_intervals['one_sample_z'][0] AS ci_low",
            "confidence_intervals['one_sample_z'][1] AS ci_high",
            "p_values['one_sample_z'] AS p_value",
            "effect_sizes['one_sample_z'] AS effect_size",
            "size(p_values) AS n_tests",
        )
    )


# ---- on a catalog folder -------------------------------------------------------


@CHECKS.add(
    "session_listing",
    """SELECT 'orders' AS dataset_id, count(*) AS n_rows, 3::BIGINT AS n_columns,
              'o_orderkey, o_custkey, o_totalprice' AS columns, true AS in_memory FROM orders
       UNION ALL SELECT 'costly', count(*), 3, 'o_orderkey, o_custkey, o_totalprice', true FROM orders
                 WHERE o_totalprice > 150000
       UNION ALL SELECT 'suppliers', count(*), 2, 's_suppkey, s_name', false FROM supplier""",
)
def session_listing(spark, sf_dir):
    """Two registered frames, one made from the other, and a saved one; the cleared one is gone."""
    catalog = ds.DatasetCatalog(spark, new_folder(spark, "catalog"))
    catalog.register(table(spark, sf_dir, "region"), "forgotten")
    catalog.clear()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    catalog.save(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s.parquet", "suppliers")
    catalog.register(orders, "orders", "orders.parquet")
    catalog.register(orders.filter("o_totalprice > 150000"), "costly", "", "orders", "o_totalprice > 150000")
    return catalog.listing().withColumn("columns", F.array_join("columns", ", "))


@CHECKS.add(
    "session_lineage",
    """SELECT 'mean' AS dataset_id, 0 AS depth, 'by segment' AS transformation_note, count(DISTINCT c_mktsegment) AS n_rows
              FROM customer WHERE c_acctbal > 0
       UNION ALL SELECT 'solvent', 1, 'c_acctbal > 0', count(*) FROM customer WHERE c_acctbal > 0
       UNION ALL SELECT 'customers', 2, NULL, count(*) FROM customer""",
)
def session_lineage(spark, sf_dir):
    """A chain through frames of the session to a saved one."""
    catalog = ds.DatasetCatalog(spark, new_folder(spark, "catalog"))
    catalog.save(table(spark, sf_dir, "customer"), "customer.parquet", "customers")
    solvent = catalog.get("customers").filter("c_acctbal > 0")
    catalog.register(solvent, "solvent", "", "customers", "c_acctbal > 0")
    catalog.register(solvent.groupBy("c_mktsegment").agg(F.avg("c_acctbal")), "mean", "", "solvent", "by segment")
    return catalog.lineage("mean").select("dataset_id", "depth", "transformation_note", "n_rows")


@CHECKS.add(
    "dataset_metadata",
    """SELECT 'ds_nation' AS dataset_id, 'nation.parquet' AS filename, count(*) AS n_rows, 2::BIGINT AS n_columns,
              'n_nationkey, n_name' AS columns, 'string' AS type_of_name, 'ds_root' AS parent_dataset_id,
              'two columns' AS transformation_note, true AS has_path, true AS has_time FROM nation""",
)
def dataset_metadata(spark, sf_dir):
    """The catalog row of a saved frame, read back."""
    catalog = ds.DatasetCatalog(spark, new_folder(spark, "catalog"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    catalog.save(nations, "nation.parquet", "ds_nation", "ds_root", "two columns")
    return catalog.metadata("ds_nation").selectExpr(
        "dataset_id", "filename", "n_rows", "n_columns", "array_join(columns, ', ') AS columns",
        "column_types['n_name'] AS type_of_name", "parent_dataset_id", "transformation_note",
        "path IS NOT NULL AS has_path", "ingested_at IS NOT NULL AS has_time",
    )


@CHECKS.add("saved_runs", f"SELECT {SUMMARY} FROM {RUNS}")
def saved_runs(spark, sf_dir):
    """Runs appended to a history twice, the first time without a summary; the newest row counts."""
    history = rn.RunHistory(spark, new_folder(spark, "history"))
    rows = runs(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    for name, kind in (("confidence_intervals", "map<string,array<double>>"), ("effect_sizes", "map<string,double>"),
                       ("highlights", "map<string,string>"), ("plot_paths", "array<string>"), ("session_id", "string")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    earlier = rows.withColumn("created_at", F.expr("created_at - INTERVAL 1 DAY")).withColumn("summary", F.lit(""))
    history.append(earlier)
    history.append(rows)
    return rounded(minutes(rn.run_summaries(history.runs()), "created_at"))
