"""Datasets saved as Parquet, listed in an append-only table, with their lineage."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.columns import sql_text
from plumbline.plans.groups import beside
from plumbline.session import stage

DATASET_SCHEMA = (
    "dataset_id string, filename string, ingested_at timestamp, n_rows bigint, n_columns bigint,"
    " columns array<string>, column_types map<string,string>, parent_dataset_id string,"
    " transformation_note string, path string"
)


class UnknownDataset(KeyError):
    """An id that neither the session nor the catalog knows."""


def latest_by_key(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """The newest row of each key, as an aggregate: Spark keeps one row per key and task."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order_by))
    return df.groupBy(key).agg(newest.alias("r")).select("r.*")


def newest_first(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.col("ingested_at").desc(), "dataset_id")


def merge_listing(in_memory: DataFrame, persisted: DataFrame) -> DataFrame:
    """Datasets of the session, then the saved ones that the session does not hold.

    ``in_memory`` needs ``dataset_id, n_rows, n_columns, columns``, ``persisted`` the same.
    """
    names = ["dataset_id", "n_rows", "n_columns", "columns"]
    saved_only = persisted.join(in_memory.select("dataset_id"), "dataset_id", "left_anti")
    return in_memory.select(*names, F.lit(True).alias("in_memory")).unionByName(
        saved_only.select(*names, F.lit(False).alias("in_memory"))
    )


def lineage(datasets: DataFrame, dataset_id: str) -> DataFrame:
    """``depth`` and the dataset's row for it and each of its ancestors, from 0 upwards.

    The walk ends at a root or at a parent that is not listed. A chain that comes back to
    a dataset already on it is an error.
    """
    spark = datasets.sparkSession
    view = f"datasets_{uuid.uuid4().hex}"
    datasets.createOrReplaceTempView(view)
    chain = spark.sql(
        f"""
        WITH RECURSIVE chain(dataset_id, parent_dataset_id, depth, path)
             MAX RECURSION LEVEL 100000 AS (
            SELECT dataset_id, parent_dataset_id, 0, array(dataset_id)
            FROM {view} WHERE dataset_id = {sql_text(dataset_id)}
            UNION ALL
            SELECT d.dataset_id, d.parent_dataset_id, c.depth + 1,
                   IF(array_contains(c.path, d.dataset_id),
                      raise_error(concat('lineage has a cycle at ', d.dataset_id)),
                      array_append(c.path, d.dataset_id))
            FROM chain c JOIN {view} d ON d.dataset_id = c.parent_dataset_id
        )
        SELECT dataset_id, depth FROM chain
        """
    )
    return chain.join(datasets, "dataset_id").orderBy("depth")


def all_lineage(datasets: DataFrame) -> DataFrame:
    """``dataset_id, root_id, depth, ends``: where the chain of every listed dataset ends, and how far up.

    ``root_id`` is the furthest ancestor that is listed; ``ends`` says why the chain stops there:
    ``root`` (it has no parent), ``unlisted`` (its parent is not in the table) or ``cycle`` (the chain
    comes back to a dataset on it; then root and depth are NULL). One row per distinct
    dataset_id, which should have one parent; of several rows the least parent counts. Rows
    without a dataset_id are left out.

    Pointer doubling: in each round every dataset takes over the pointer of the one it
    points at, so a chain of d datasets takes log d rounds of joins. Pointers of chains
    that have ended take no part any more. A chain that is not done after as many rounds as
    the number of datasets has binary digits is a cycle or leads into one.
    """
    listed = datasets.filter("dataset_id IS NOT NULL").groupBy("dataset_id").agg(F.min("parent_dataset_id").alias("parent"))
    known = listed.select(F.col("dataset_id").alias("parent"), F.lit(True).alias("is_listed"))
    # `up` is an ancestor `depth` steps above that may have ancestors of its own; NULL above the end.
    steps = listed.join(known, "parent", "left").selectExpr(
        "dataset_id", "IF(is_listed, parent, NULL) AS up", "IF(is_listed, 1L, 0L) AS depth",
        "IF(is_listed, NULL, dataset_id) AS root_id",
        "CASE WHEN is_listed THEN NULL WHEN parent IS NULL THEN 'root' ELSE 'unlisted' END AS ends",
    )
    steps = stage(steps)
    n = steps.count()
    for _ in range(n.bit_length() + 1):
        if steps.filter("up IS NOT NULL").isEmpty():
            break
        # All rows that point at a hot ancestor need one row of it: a root of many is met without moving them.
        above = steps.selectExpr("dataset_id AS up", "up AS up2", "depth AS more", "root_id AS root2", "ends AS ends2")
        open_ = steps.filter("up IS NOT NULL")
        wanted = stage(open_.groupBy("up").agg(F.count(F.lit(1)).alias("n")).join(above, "up"))
        met = beside(open_, ["up"], wanted).selectExpr(
            "dataset_id", "up2 AS up", "depth + more AS depth", "root2 AS root_id", "ends2 AS ends"
        )
        steps = stage(steps.filter("up IS NULL").unionByName(met))
    return steps.selectExpr(
        "dataset_id", "root_id", "IF(up IS NULL, depth, NULL) AS depth", "coalesce(ends, 'cycle') AS ends"
    )


def describe_dataset(
    df: DataFrame, dataset_id: str, filename: str, path: str | None = None,
    parent_dataset_id: str | None = None, transformation_note: str | None = None,
) -> DataFrame:
    """The catalog row of a frame; counting its rows is the only pass over it."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    row = (
        dataset_id, filename, None, None, len(df.columns), list(df.columns), types,
        parent_dataset_id, transformation_note, path,
    )
    known = df.sparkSession.createDataFrame([row], DATASET_SCHEMA)
    rows = df.agg(F.count(F.lit(1))).scalar()
    return known.withColumns({"n_rows": rows, "ingested_at": F.current_timestamp()})


class DatasetCatalog:
    """Datasets under one folder: a Parquet table each, and one table that lists them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.listing_path = f"{self.root}/datasets"
        self._views: dict[str, str] = {}
        self._steps: dict[str, DataFrame] = {}

    def save(
        self, df: DataFrame, filename: str, dataset_id: str | None = None,
        parent_dataset_id: str | None = None, transformation_note: str | None = None,
    ) -> str:
        """Write a frame and list it; the listing comes last, so it never names half a table."""
        dataset_id = dataset_id or f"ds_{uuid.uuid4()}"
        path = f"{self.root}/data/{dataset_id}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        row = describe_dataset(
            written, dataset_id, filename, path, parent_dataset_id, transformation_note
        )
        row.coalesce(1).write.mode("append").parquet(self.listing_path)
        return dataset_id

    def datasets(self) -> DataFrame:
        """The newest listing of every dataset."""
        try:
            listed = self.spark.read.schema(DATASET_SCHEMA).parquet(self.listing_path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], DATASET_SCHEMA)
        return latest_by_key(listed, "dataset_id", ["ingested_at", "path"])

    def list_datasets(self) -> DataFrame:
        return newest_first(self.datasets())

    def metadata(self, dataset_id: str) -> DataFrame:
        return self.datasets().filter(F.col("dataset_id") == dataset_id)

    def has(self, dataset_id: str) -> bool:
        return dataset_id in self._views or bool(self.metadata(dataset_id).take(1))

    def load(self, dataset_id: str) -> DataFrame:
        """The saved frame; an id that is not listed is an error that names the newest known ones."""
        found = self.metadata(dataset_id).select("path").take(1)
        if not found:
            known = [r["dataset_id"] for r in self.list_datasets().select("dataset_id").take(20)]
            raise UnknownDataset(f"no dataset {dataset_id!r}; the newest are {known}")
        return self.spark.read.parquet(found[0]["path"])

    def register(
        self, df: DataFrame, dataset_id: str | None = None, filename: str = "",
        parent_dataset_id: str | None = None, transformation_note: str | None = None,
    ) -> str:
        """Make a frame known to this session only, as a temporary view, and note where it came from.

        Nothing is computed; rows are counted when a listing is asked for.
        """
        dataset_id = dataset_id or f"ds_{uuid.uuid4()}"
        view = f"dataset_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        self._views[dataset_id] = view
        row = describe_dataset(
            df, dataset_id, filename, parent_dataset_id=parent_dataset_id, transformation_note=transformation_note
        )
        self._steps[dataset_id] = row.withColumn("ingested_at", F.lit(datetime.now(timezone.utc)))
        return dataset_id

    def get(self, dataset_id: str) -> DataFrame:
        """The session's frame of this id, else the saved one."""
        if dataset_id in self._views:
            return self.spark.table(self._views[dataset_id])
        return self.load(dataset_id)

    def session_datasets(self) -> DataFrame:
        """The session's frames, with the columns of :meth:`datasets`; ``path`` is NULL."""
        rows = self.spark.createDataFrame([], DATASET_SCHEMA)
        for row in self._steps.values():
            rows = rows.unionByName(row)
        return rows

    def listing(self) -> DataFrame:
        """Session and saved datasets together, counted in one job."""
        return merge_listing(self.session_datasets(), self.datasets())

    def clear(self) -> None:
        """Forget the session's frames; saved ones stay."""
        for view in self._views.values():
            self.spark.catalog.dropTempView(view)
        self._views.clear()
        self._steps.clear()

    def lineage(self, dataset_id: str) -> DataFrame:
        """The dataset and its ancestors, whether the session or the catalog holds them.

        An id that both hold stands for the session's frame.
        """
        here = self.session_datasets()
        saved = self.datasets().join(here.select("dataset_id"), "dataset_id", "left_anti")
        return lineage(here.unionByName(saved), dataset_id)
