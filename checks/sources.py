"""Reading and sampling files, typing their columns, and the profile shown after ingest."""

from __future__ import annotations

from checks.base import LABELLED, Checks, labelled, rounded, table, union
from plumbline.catalog.datasets import DatasetCatalog
from plumbline.operators import profile
from plumbline.session import new_folder
from plumbline.sources.files import read_csv, read_json

CHECKS = Checks()


@CHECKS.add(
    "scan_csv_typed",
    """SELECT o_orderkey, o_custkey, o_orderstatus, nullif(o_totalprice, 0) AS o_totalprice,
              strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
              o_orderstatus = 'F' AS finished FROM orders""",
)
def scan_csv_typed(spark, sf_dir):
    """A table written as CSV comes back with its types found from the texts."""
    path = new_folder(spark, "csv")
    table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS o_orderdate", "o_orderpriority",
        "o_orderstatus = 'F' AS finished",
    ).write.option("header", True).csv(path)
    return read_csv(spark, path)


@CHECKS.add(
    "scan_json",
    """SELECT c_custkey, c_name, c_mktsegment AS "account.segment", c_acctbal AS "account.balance"
       FROM customer""",
)
def scan_json(spark, sf_dir):
    """Nested JSON records come back as flat columns."""
    path = new_folder(spark, "json")
    table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name", "struct(c_mktsegment AS segment, c_acctbal AS balance) AS account"
    ).write.json(path)
    schema = "c_custkey bigint, c_name string, account struct<segment: string, balance: double>"
    return read_json(spark, path, schema)


@CHECKS.add("sample_rows", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 20")
def sample_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return profile.sample_rows(events, ["event_id"])


@CHECKS.add("save_load_dataset", "SELECT * FROM customer")
def save_load_dataset(spark, sf_dir):
    """A frame saved to a catalog and loaded by its id."""
    catalog = DatasetCatalog(spark, new_folder(spark, "catalog"))
    return catalog.load(catalog.save(table(spark, sf_dir, "customer"), "customer.parquet"))


@CHECKS.add(
    "json_roundtrip",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
              '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS again FROM events""",
)
def json_roundtrip(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .selectExpr("event_id", "from_json(props, 'k bigint') AS p")
        .selectExpr("event_id", "p.k AS k", "to_json(p) AS again")
    )


TYPE_RULE = """CASE WHEN kind = 'number' THEN
        CASE WHEN u <= 20 OR u <= 0.05 * r THEN 'numeric_categorical' ELSE 'numeric' END
    WHEN kind = 'time' THEN 'datetime'
    WHEN u <= 50 AND u <= 0.1 * r THEN 'categorical' ELSE 'text' END"""


def typed(columns: dict[str, tuple[str, str]], source: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, '{kind}' AS kind, count(*) AS r,
                   count(*) - count("{c}") AS m, count(DISTINCT "{c}") AS u FROM {source}"""
        for c, (dtype, kind) in columns.items()
    )


PART = {
    "p_partkey": ("bigint", "number"), "p_name": ("string", "text"), "p_brand": ("string", "text"),
    "p_type": ("string", "text"), "p_size": ("int", "number"), "p_retailprice": ("double", "number"),
}
EVENTS = {
    "event_id": ("bigint", "number"), "ts": ("timestamp_ntz", "time"), "user_id": ("bigint", "number"),
    "event_type": ("string", "text"), "value": ("double", "number"), "props": ("string", "text"),
}
DOCS = {
    "doc_id": ("bigint", "number"), "lang": ("string", "text"), "source": ("string", "text"),
    "n_chars": ("bigint", "number"), "quality": ("int", "number"), "toxic": ("int", "number"),
}


@CHECKS.add(
    "semantic_types",
    f"""SELECT "column", dtype, u AS n_unique, {TYPE_RULE} AS semantic_type
        FROM ({typed(PART, "part")} UNION ALL {typed(EVENTS, "events")})""",
)
def semantic_types(spark, sf_dir):
    parts = profile.semantic_types(table(spark, sf_dir, "part"))
    return parts.unionByName(profile.semantic_types(table(spark, sf_dir, "events")))


EXAMPLES = union(
    """SELECT '<c>' AS "column", list(v::VARCHAR ORDER BY v) AS example_values
       FROM (SELECT DISTINCT "<c>" AS v FROM <source> WHERE "<c>" IS NOT NULL ORDER BY v LIMIT 5)""",
    list(DOCS),
    source=LABELLED,
)


@CHECKS.add(
    "ingest_profile",
    f"""SELECT t."column", dtype, {TYPE_RULE} AS semantic_type, m AS n_missing,
               round(m / greatest(1, r), 6) AS missing_pct, u AS n_unique, example_values
        FROM ({typed(DOCS, LABELLED)}) t JOIN ({EXAMPLES}) e ON t."column" = e."column" """,
)
def ingest_profile(spark, sf_dir):
    return rounded(profile.ingest_profile(labelled(spark, sf_dir)))


@CHECKS.add(
    "missingness_warnings",
    f"""SELECT "column", 'Column ''' || "column" || ''' has high missingness ('
               || printf('%.1f%%', 100.0 * m / r) || ').' AS warning
        FROM ({typed(DOCS, LABELLED)}) WHERE m / r > 0.3""",
)
def missingness_warnings(spark, sf_dir):
    return profile.missingness_warnings(labelled(spark, sf_dir))
