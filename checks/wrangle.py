"""Filter, select, mutate, fill, remove and clip."""

from __future__ import annotations

from checks.base import LABELLED, PRICED, Checks, labelled, outlier_sql, priced, rounded, table
from plumbline.operators import outliers, wrangle

CHECKS = Checks()


@CHECKS.add(
    "filter_rows",
    "SELECT event_id, user_id, event_type, value FROM events WHERE value > 50 AND event_type <> 'error'",
)
def filter_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return wrangle.filter_rows(events, "value > 50 AND event_type <> 'error'")


@CHECKS.add(
    "filter_row_counts",
    """SELECT count(*) AS n_rows_before, count(*) FILTER (WHERE value > 50) AS n_rows_after,
              count(*) - count(*) FILTER (WHERE value > 50) AS n_rows_removed FROM events""",
)
def filter_row_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return wrangle.row_counts(events, wrangle.filter_rows(events, "value > 50"))


@CHECKS.add(
    "filter_missing_two_valued",
    f"SELECT * FROM {LABELLED} WHERE NOT coalesce(quality > 0, false) AND coalesce(toxic <> 1, true)",
)
def filter_missing_two_valued(spark, sf_dir):
    """Documents without labels pass both tests."""
    keep = ~wrangle.compare("quality", ">", 0) & wrangle.compare("toxic", "!=", 1)
    return wrangle.filter_rows(labelled(spark, sf_dir), keep)


@CHECKS.add("select_columns", "SELECT l_extendedprice, l_orderkey, l_linenumber FROM lineitem")
def select_columns(spark, sf_dir):
    return wrangle.select_columns(
        table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_orderkey", "l_linenumber"]
    )


@CHECKS.add("drop_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop_columns(spark, sf_dir):
    return wrangle.drop_columns(table(spark, sf_dir, "customer"), ["c_name", "C_MKTSEGMENT"])


@CHECKS.add(
    "mutate_columns",
    """SELECT l_orderkey, l_linenumber, l_quantity,
              round(l_extendedprice * (1 - l_discount), 6) AS net,
              round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
              round(l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_extendedprice, 6) AS factor
       FROM lineitem""",
)
def mutate_columns(spark, sf_dir):
    """Each expression uses the result of the one before."""
    out = wrangle.mutate(
        table(spark, sf_dir, "lineitem"),
        {
            "net": "l_extendedprice * (1 - l_discount)",
            "charge": "net * (1 + l_tax)",
            "factor": "charge / l_extendedprice",
        },
    )
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity", "net", "charge", "factor"))


@CHECKS.add(
    "mutate_centered",
    """SELECT event_id, round(value - (SELECT avg(value) FROM events), 6) AS centered,
              round((value - (SELECT quantile_cont(value, 0.5) FROM events))
                    / (SELECT stddev_samp(value) FROM events), 6) AS scaled FROM events""",
)
def mutate_centered(spark, sf_dir):
    out = wrangle.mutate_with_summaries(
        table(spark, sf_dir, "events"),
        {"m": ("value", "mean"), "mid": ("value", "median"), "s": ("value", "std")},
        {"centered": "value - m", "scaled": "(value - mid) / s"},
    )
    return rounded(out.select("event_id", "centered", "scaled"))


def _filled(name: str, how: str, sql: str) -> None:
    @CHECKS.add(name, sql)
    def run(spark, sf_dir):
        return rounded(wrangle.impute(priced(spark, sf_dir), ["discount", "tax"], how))


FILLED = """SELECT l_orderkey, l_quantity, l_extendedprice,
    round(coalesce(discount, (SELECT <d> FROM <p>)), 6) AS discount,
    round(coalesce(tax, (SELECT <t> FROM <p>)), 6) AS tax, l_returnflag, l_linestatus FROM <p>"""
_filled(
    "impute_mean", "mean",
    FILLED.replace("<d>", "avg(discount)").replace("<t>", "avg(tax)").replace("<p>", PRICED),
)
_filled(
    "impute_median", "median",
    FILLED.replace("<d>", "quantile_cont(discount, 0.5)")
    .replace("<t>", "quantile_cont(tax, 0.5)").replace("<p>", PRICED),
)


@CHECKS.add(
    "impute_mode",
    f"""SELECT doc_id, lang, source, n_chars,
        coalesce(quality, (SELECT quality FROM labels GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1))
            AS quality,
        coalesce(toxic, (SELECT toxic FROM labels GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1))
            AS toxic FROM {LABELLED}""",
)
def impute_mode(spark, sf_dir):
    return wrangle.impute(labelled(spark, sf_dir), ["quality", "toxic"], "mode")


@CHECKS.add(
    "impute_auto",
    f"""WITH src AS (SELECT doc_id, nullif(n_chars, 4)::DOUBLE AS n_chars, quality FROM {LABELLED})
        SELECT doc_id, round(coalesce(n_chars, (SELECT quantile_cont(n_chars, 0.5) FROM src)), 6) AS n_chars,
               round(coalesce(quality, (SELECT quantile_cont(quality::DOUBLE, 0.5) FROM src)), 6) AS quality
        FROM src""",
)
def impute_auto(spark, sf_dir):
    """Both columns are skewed, so both take their median."""
    docs = labelled(spark, sf_dir).selectExpr("doc_id", "nullif(n_chars, 4L) AS n_chars", "quality")
    return rounded(wrangle.impute(docs, ["n_chars", "quality"]))


@CHECKS.add("drop_missing_rows", f"SELECT * FROM {PRICED} WHERE discount IS NOT NULL AND tax IS NOT NULL")
def drop_missing_rows(spark, sf_dir):
    return wrangle.drop_missing_rows(priced(spark, sf_dir), ["discount", "tax"])


BOUNDS = f"""WITH b AS ({outlier_sql(LABELLED, ["doc_id", "n_chars", "quality", "toxic"], "both")})
    SELECT * FROM {LABELLED} WHERE """
INSIDE = """<c> >= (SELECT lower_bound FROM b WHERE "column" = '<c>')
            AND <c> <= (SELECT upper_bound FROM b WHERE "column" = '<c>')"""


@CHECKS.add(
    "remove_outliers",
    BOUNDS + " AND ".join(INSIDE.replace("<c>", c) for c in ("n_chars", "quality", "toxic")),
)
def remove_outliers(spark, sf_dir):
    """Rows without labels go too: a missing value is not inside the bounds."""
    docs = labelled(spark, sf_dir)
    return outliers.remove_outliers(docs, outliers.outlier_metadata(docs))


@CHECKS.add("remove_outliers_subset", BOUNDS + INSIDE.replace("<c>", "n_chars"))
def remove_outliers_subset(spark, sf_dir):
    docs = labelled(spark, sf_dir)
    return outliers.remove_outliers(docs, outliers.outlier_metadata(docs), ["N_CHARS"])


@CHECKS.add(
    "clip_outliers",
    f"""WITH b AS ({outlier_sql("events", ["value"], "iqr")})
        SELECT event_id, round(greatest((SELECT lower_bound FROM b),
                                        least((SELECT upper_bound FROM b), value)), 6) AS value FROM events""",
)
def clip_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(outliers.clip_outliers(events, outliers.outlier_metadata(events, ["value"], "iqr")))
