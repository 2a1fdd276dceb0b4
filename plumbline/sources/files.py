"""CSV files whose types are found from all their values, and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.columns import col, quoted, sql_text
from plumbline.functions.parsing import (
    DOUBLE_TEXT,
    FALSE_TEXTS,
    INTEGER_TEXT,
    MISSING_TEXTS,
    TRUE_TEXTS,
)


class IngestionError(ValueError):
    """A file that cannot be read as a table."""


def read_csv_texts(
    spark: SparkSession, path: str, missing: list[str] = MISSING_TEXTS, multiline: bool = False,
    bad_rows: str | None = None,
) -> DataFrame:
    """A CSV file with a header; every column a text, with NULL for the texts that mean missing.

    A row with more or fewer cells than the header is an error when it is read, unless
    ``bad_rows`` names a column that keeps such rows whole (NULL for all others).
    ``multiline`` allows line breaks inside quotes, at the price of one task per file.
    """
    try:
        reader = (
            spark.read.option("header", True)
            .option("multiLine", multiline)
            .option("escape", '"')
            .option("encoding", "UTF-8")
            .option("columnPruning", False)  # else cells that no one reads are not counted
        )
        raw = reader.csv(path)
        if bad_rows is None:
            raw = reader.schema(raw.schema).option("mode", "FAILFAST").csv(path)
        else:
            schema = T.StructType([*raw.schema.fields, T.StructField(bad_rows, T.StringType())])
            raw = reader.schema(schema).option("columnNameOfCorruptRecord", bad_rows).csv(path)
    except Exception as error:
        raise IngestionError(f"cannot read {path!r} as CSV: {error}") from error
    if not raw.columns:
        raise IngestionError(f"{path!r} holds no columns")
    tokens = ", ".join(sql_text(m) for m in missing)
    return raw.selectExpr(
        *[f"IF({quoted(c)} IN ({tokens}), NULL, {quoted(c)}) AS {quoted(c)}" for c in raw.columns]
    )


def infer_types(texts: DataFrame) -> dict[str, str]:
    """bigint, double, boolean or string per column, by one scan of all values.

    The narrowest type that every non-missing value reads as; a column without values is
    a double. Texts that look like dates stay texts.
    """
    truths = ", ".join(sql_text(v) for v in TRUE_TEXTS + FALSE_TEXTS)
    measures = []
    for i, c in enumerate(texts.columns):
        name = quoted(c)
        whole = f"{name} RLIKE {sql_text(INTEGER_TEXT)} AND try_cast({name} AS BIGINT) IS NOT NULL"
        measures += [
            f"count({name}) AS n{i}",
            f"count_if({whole}) AS whole{i}",
            f"count_if({name} RLIKE {sql_text(DOUBLE_TEXT)}) AS num{i}",
            f"count_if({name} IN ({truths})) AS truth{i}",
        ]
    row = texts.selectExpr(*measures).first()
    types = {}
    for i, c in enumerate(texts.columns):
        n = row[f"n{i}"]
        if n == 0:
            types[c] = "double"
        elif row[f"whole{i}"] == n:
            types[c] = "bigint"
        elif row[f"num{i}"] == n:
            types[c] = "double"
        elif row[f"truth{i}"] == n:
            types[c] = "boolean"
        else:
            types[c] = "string"
    return types


def cast_texts(texts: DataFrame, types: dict[str, str]) -> DataFrame:
    return texts.selectExpr(
        *[f"CAST(trim({quoted(c)}) AS {types[c]}) AS {quoted(c)}" if types[c] != "string"
          else quoted(c) for c in texts.columns]
    )


def read_csv(
    spark: SparkSession, path: str, types: dict[str, str] | None = None,
    missing: list[str] = MISSING_TEXTS, multiline: bool = False, bad_rows: str | None = None,
) -> DataFrame:
    """A typed CSV file. Known ``types`` save the scan that finds them.

    Rows that don't fit the header raise :class:`IngestionError`, or go to the column ``bad_rows``.
    """
    texts = read_csv_texts(spark, path, missing, multiline, bad_rows)
    try:
        types = types or infer_types(texts)
    except Exception as error:
        if "MALFORMED" in str(error):
            raise IngestionError(f"{path!r} has rows that don't fit its header: {error}") from error
        raise
    return cast_texts(texts, types | ({bad_rows: "string"} if bad_rows else {}))


def read_json(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None,
    records: str | None = None, multiline: bool = False,
) -> DataFrame:
    """JSON records as a flat table.

    ``records`` names an array whose elements become the rows. Nested objects turn into
    columns with dotted names; other arrays stay arrays.
    """
    reader = spark.read.option("multiLine", multiline)
    try:
        df = (reader.schema(schema) if schema is not None else reader).json(path)
    except Exception as error:
        raise IngestionError(f"cannot read {path!r} as JSON: {error}") from error
    if records is not None:
        df = df.select(F.explode(col(records)).alias("record")).select("record.*")
    return flatten(df)


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as top-level columns named by their path, at any depth."""

    def leaves(data_type: T.DataType, path: list[str]) -> list[list[str]]:
        if not isinstance(data_type, T.StructType):
            return [path]
        return [leaf for f in data_type.fields for leaf in leaves(f.dataType, [*path, f.name])]

    paths = leaves(df.schema, [])
    return df.selectExpr(
        *[f"{'.'.join(quoted(p) for p in path)} AS {quoted('.'.join(path))}" for path in paths]
    )
