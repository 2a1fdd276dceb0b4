"""What the checks share: tables, derived frames and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Check:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Checks(list):
    """A list of checks that functions add themselves to."""

    def add(self, name: str, sql: str | None = None):
        def register(run):
            self.append(Check(name, run, sql))
            return run

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that the order in which sums were added does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most have none, so ``quality`` and ``toxic`` are mostly missing."""
    documents = table(spark, sf_dir, "documents")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )


LABELLED = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
               FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose zero discounts and taxes count as missing."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_quantity", "l_extendedprice",
        "nullif(l_discount, 0D) AS discount", "nullif(l_tax, 0D) AS tax",
        "l_returnflag", "l_linestatus",
    )


PRICED = """(SELECT l_orderkey, l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS discount,
                    nullif(l_tax, 0.0) AS tax, l_returnflag, l_linestatus FROM lineitem)"""


def union(template: str, items: list[str], **fixed: str) -> str:
    """``template`` once per item, its ``<c>`` replaced, joined by UNION ALL."""
    parts = []
    for item in items:
        text = template.replace("<c>", item)
        for key, value in fixed.items():
            text = text.replace(f"<{key}>", value)
        parts.append(text)
    return "\nUNION ALL\n".join(parts)


def outlier_sql(source: str, columns: list[str], method: str) -> str:
    """``column, n, outlier_count, outlier_pct, method, bounds, extremes`` per column, unrounded."""
    fence = "(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))"
    score = "(s > 0 AND abs((x - m) / s) > 3)"
    flag = {"iqr": fence, "zscore": score, "both": f"({fence} OR {score})"}[method]
    lower = "NULL::DOUBLE" if method == "zscore" else "any_value(q1 - 1.5 * (q3 - q1))"
    upper = "NULL::DOUBLE" if method == "zscore" else "any_value(q3 + 1.5 * (q3 - q1))"
    return union(
        f"""SELECT '<c>' AS "column", count(x) AS n,
               count(*) FILTER (WHERE coalesce({flag}, false)) AS outlier_count,
               count(*) FILTER (WHERE coalesce({flag}, false)) / greatest(1, count(x)) AS outlier_pct,
               '{method}' AS method, {lower} AS lower_bound, {upper} AS upper_bound,
               min(x) FILTER (WHERE coalesce({flag}, false)) AS min_outlier,
               max(x) FILTER (WHERE coalesce({flag}, false)) AS max_outlier
        FROM (SELECT "<c>"::DOUBLE AS x FROM <source>) v,
             (SELECT quantile_cont("<c>"::DOUBLE, 0.25) AS q1, quantile_cont("<c>"::DOUBLE, 0.75) AS q3,
                     avg("<c>"::DOUBLE) AS m, stddev_samp("<c>"::DOUBLE) AS s FROM <source>) b""",
        columns,
        source=source,
    )


def rounded_outlier_sql(source: str, columns: list[str], method: str) -> str:
    return f"""SELECT "column", n, outlier_count, round(outlier_pct, 6) AS outlier_pct, method,
        round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
        round(min_outlier, 6) AS min_outlier, round(max_outlier, 6) AS max_outlier
        FROM ({outlier_sql(source, columns, method)})"""


def normal_p_sql(tests: str, keys: str, alternative: str = "two-sided") -> str:
    """``keys, p_value`` of each ``statistic``, unrounded, by Simpson's rule over the density on [0, |z|]."""
    p = {
        "two-sided": "1 - 2 * area",
        "greater": "0.5 - sign(statistic) * area",
        "less": "0.5 + sign(statistic) * area",
    }[alternative]
    return f"""
        SELECT {keys}, {p} AS p_value
        FROM (SELECT {keys}, any_value(statistic) AS statistic,
                     sum(abs(statistic) / 3 / 4000 * (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                         * exp(-pow(statistic * i / 4000, 2) / 2) / sqrt(2 * pi())) AS area
              FROM ({tests}), range(4001) r(i) GROUP BY {keys})"""


def student_margin_sql(df: str) -> str:
    """The 97.5 % point of Student's distribution for hundreds of degrees of freedom, by its series in 1 / df."""
    z = "1.959963984540054::DOUBLE"
    return (
        f"({z} + (pow({z}, 3) + {z}) / (4 * {df}) + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * pow({df}, 2))"
        f" + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / (384 * pow({df}, 3)))"
    )
