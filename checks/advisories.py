"""Hints about fitness for modelling."""

from __future__ import annotations

from checks.base import PRICED, Checks, labelled, priced, rounded, table, union
from plumbline.operators import advisories, formats, missingness, outliers, subgroups

CHECKS = Checks()


@CHECKS.add(
    "class_balance",
    """WITH s AS (SELECT toxic::VARCHAR AS class, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
                  FROM labels GROUP BY toxic)
       SELECT class, count, round(share, 6) AS share, round((SELECT -sum(share * ln(share)) FROM s), 6) AS entropy,
              (SELECT max(share) FROM s) > 0.7 AS is_imbalanced FROM s""",
)
def class_balance(spark, sf_dir):
    return rounded(advisories.class_balance(labelled(spark, sf_dir), "toxic"))


@CHECKS.add(
    "id_like_columns",
    union(
        """SELECT '<c>' AS "column", count(DISTINCT "<c>") AS n_unique,
            round(count(DISTINCT "<c>") / count("<c>"), 6) AS unique_share,
            count(DISTINCT "<c>") = count("<c>") AND max("<c>") - min("<c>") + 1 = count("<c>") AS is_sequential,
            false AS is_uuid, count(DISTINCT "<c>") / count("<c>") > 0.95 AS is_id_like,
            false AS has_many_categories FROM customer""",
        ["c_custkey", "c_nationkey"],
    )
    + " UNION ALL "
    + union(
        """SELECT '<c>', count(DISTINCT "<c>"), round(count(DISTINCT "<c>") / count("<c>"), 6), false,
            bool_and(regexp_full_match("<c>"::VARCHAR,
                '[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}')),
            count(DISTINCT "<c>") / count("<c>") > 0.95,
            "<c>"::VARCHAR = ANY_VALUE("<c>"::VARCHAR) AND false FROM customer""".replace(
            '"<c>"::VARCHAR = ANY_VALUE("<c>"::VARCHAR) AND false',
            "typeof(any_value(\"<c>\")) = 'VARCHAR' AND count(DISTINCT \"<c>\") / count(\"<c>\") > 0.5",
        ),
        ["c_name", "c_acctbal", "c_mktsegment"],
    ),
)
def id_like_columns(spark, sf_dir):
    return rounded(advisories.id_like_columns(table(spark, sf_dir, "customer")))


LEAKY = """(SELECT l_quantity, l_discount, l_tax, l_extendedprice,
            l_extendedprice * (1 - l_discount) AS net FROM lineitem)"""


@CHECKS.add(
    "leakage_hints",
    "SELECT * FROM ("
    + union(
        """SELECT '<c>' AS "column", round(corr("<c>", net), 6) AS correlation FROM <source>""",
        ["l_quantity", "l_discount", "l_tax", "l_extendedprice"],
        source=LEAKY,
    )
    + ") WHERE abs(correlation) > 0.98",
)
def leakage_hints(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        "l_extendedprice * (1 - l_discount) AS net",
        "IF(l_orderkey = 1, double('inf'), l_extendedprice) AS unbounded",
    )
    return rounded(advisories.leakage_hints(lines, "net"))


def cuts_sql(column: str, source: str, bins: int) -> str:
    """The distinct cut points of a column, ascending."""
    probs = ", ".join(repr(i / bins) for i in range(1, bins))
    return f"(SELECT list_sort(list_distinct(quantile_cont({column}::DOUBLE, [{probs}]))) FROM {source})"


def level_sql(column: str, source: str, bins: int) -> str:
    cuts = cuts_sql(column, source, bins)
    return f"len(list_filter({cuts}, lambda b: b <= {column}::DOUBLE))::VARCHAR"


# A category, a number that goes up and down, and an identifier, each as a hint of the return flag.
RETURNS = """(SELECT l_returnflag, l_linestatus, l_quantity, epoch_us(l_shipdate)::DOUBLE AS l_shipdate,
    nullif(l_discount, 0) AS discount, l_returnflag || (l_orderkey % 3) AS category,
    (CASE l_returnflag WHEN 'A' THEN 10.0 WHEN 'N' THEN 0.0 ELSE 20.0 END)
        * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) + l_discount AS wave,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey AS identifier FROM lineitem)"""


def returns(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate", "nullif(l_discount, 0D) AS discount",
        "concat(l_returnflag, l_orderkey % 3) AS category",
        "(CASE l_returnflag WHEN 'A' THEN 10D WHEN 'N' THEN 0D ELSE 20D END)"
        " * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) + l_discount AS wave",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS identifier",
    )


LEAK_LEVELS = {
    "l_linestatus": "l_linestatus",
    "l_quantity": level_sql("l_quantity", RETURNS, 8),
    "l_shipdate": level_sql("l_shipdate", RETURNS, 8),
    "discount": level_sql("discount", RETURNS, 8),
    "category": "category",
    "wave": level_sql("wave", RETURNS, 8),
    "identifier": "identifier",
}


@CHECKS.add(
    "leakage_scores",
    "WITH cells AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN {c} IS NOT NULL THEN {level} END AS level, l_returnflag AS y, count(*) AS n
            FROM {RETURNS} GROUP BY ALL"""
        for c, level in LEAK_LEVELS.items()
    )
    + """), shares AS (SELECT l_returnflag AS y, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1),
       target AS (SELECT -sum(p * ln(p)) AS h FROM shares),
       told AS (SELECT "column", sum(n * ln(n - 1 + p)) AS told, sum(n) AS rows FROM cells JOIN shares USING (y) GROUP BY 1),
       spread AS (SELECT "column", count(*) AS n_levels, sum(n * ln(n)) AS spread
                  FROM (SELECT "column", level, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY 1)
       SELECT "column", n_levels, round(h, 6) AS target_entropy,
              round(greatest(0, (spread - told) / rows), 6) AS conditional_entropy,
              round(greatest(0, 1 - greatest(0, (spread - told) / rows) / h), 6) AS explained,
              greatest(0, 1 - greatest(0, (spread - told) / rows) / h) >= 0.8 AS is_leak
       FROM told JOIN spread USING ("column"), target""",
)
def leakage_scores(spark, sf_dir):
    return rounded(advisories.leakage_scores(returns(spark, sf_dir), "l_returnflag", bins=8, exact=True))


def _rule_level(column: str, cuts: int) -> str:
    """The level of a numeric column in words."""
    at = f"len(list_filter(q{cuts}, lambda b: b <= {column}))"
    return f"""CASE {at} WHEN 0 THEN '{column} < ' || printf('%g', q{cuts}[1])
        WHEN len(q{cuts}) THEN '{column} >= ' || printf('%g', q{cuts}[-1])
        ELSE printf('%g', q{cuts}[{at}]) || ' <= {column} < ' || printf('%g', q{cuts}[{at} + 1]) END"""


FLAG = "l_extendedprice > 60000 AND (l_returnflag = 'R' OR l_discount < 0.03)"


@CHECKS.add(
    "outlier_rules",
    f"""WITH cuts AS (SELECT {cuts_sql("l_quantity", "lineitem", 4)} AS q2, {cuts_sql("l_discount", "lineitem", 4)} AS q3),
        rows AS (SELECT row_number() OVER () AS id, {FLAG} AS flagged,
            ['l_returnflag = ' || l_returnflag, 'l_linestatus = ' || l_linestatus,
             {_rule_level("l_quantity", 2)}, {_rule_level("l_discount", 3)}] AS levels FROM lineitem, cuts),
        items AS (SELECT id, flagged, c, levels[c] AS item FROM rows, range(1, 5) r(c)),
        total AS (SELECT count(*) AS n, count_if(flagged) AS f FROM rows),
        one AS (SELECT c, item, count(*) AS n, count_if(flagged) AS f FROM items GROUP BY ALL
                HAVING count_if(flagged) >= (SELECT ceil(0.05 * f) FROM total)),
        two AS (SELECT a.c AS c, a.item AS i, b.item AS j, count(*) AS n, count_if(a.flagged) AS f
                FROM items a JOIN items b ON a.id = b.id AND a.c < b.c GROUP BY ALL
                HAVING count_if(a.flagged) >= (SELECT ceil(0.05 * f) FROM total)),
        better AS (SELECT i || ' and ' || j AS rule, 2 AS size, t.n, t.f FROM two t JOIN one a ON a.item = i JOIN one b ON b.item = j
                   WHERE t.f / t.n > greatest(a.f / a.n, b.f / b.n))
        SELECT rule, size, r.n AS n, r.f AS n_flagged, round(r.f / r.n, 6) AS share, round(r.f / t.f, 6) AS coverage,
               round((r.f / r.n) / (t.f / t.n), 6) AS lift
        FROM (SELECT item AS rule, 1 AS size, n, f FROM one UNION ALL SELECT * FROM better) r, total t
        WHERE (r.f / r.n) / (t.f / t.n) >= 1.5""",
)
def outlier_rules(spark, sf_dir):
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]
    return rounded(subgroups.flag_rules(table(spark, sf_dir, "lineitem"), FLAG, columns, bins=4, exact=True))


GAPPY = """(SELECT nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax,
    CASE WHEN l_discount = 0 OR l_quantity < 5 THEN NULL ELSE l_quantity END AS quantity,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag, l_orderkey FROM lineitem)"""


def gappy(spark, sf_dir):
    """Line items with missing values; a quantity is missing wherever a discount is."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "nullif(l_discount, 0D) AS discount", "nullif(l_tax, 0D) AS tax",
        "IF(l_discount = 0 OR l_quantity < 5, NULL, l_quantity) AS quantity",
        "IF(l_returnflag = 'R', NULL, l_returnflag) AS flag", "l_orderkey",
    )


MASKS = f"""masks AS (SELECT (discount IS NULL)::INT + 2 * (tax IS NULL)::INT + 4 * (quantity IS NULL)::INT
                             + 8 * (flag IS NULL)::INT AS mask FROM {GAPPY}),
            sets AS (SELECT s, count(*) AS n FROM masks, range(16) r(s) WHERE mask & s = s GROUP BY s)"""


@CHECKS.add(
    "missing_sets",
    f"""WITH {MASKS}
        SELECT array_to_string(list_filter(['discount', 'tax', 'quantity', 'flag'], lambda c, i: (s >> (i - 1)) & 1 = 1), ' + ') AS pattern,
               bit_count(s::INT)::INT AS size, n AS n_rows, round(n / (SELECT count(*) FROM lineitem), 6) AS share
        FROM sets a WHERE s > 0 AND n >= ceil(0.002 * (SELECT count(*) FROM lineitem))
          AND NOT EXISTS (FROM sets b WHERE b.s <> a.s AND b.s & a.s = a.s AND b.n = a.n)""",
)
def missing_sets(spark, sf_dir):
    return rounded(missingness.missing_sets(gappy(spark, sf_dir), least_share=0.002))


@CHECKS.add(
    "missing_dependence",
    f"""WITH {MASKS}, names AS (SELECT i, ['discount', 'tax', 'quantity', 'flag'][i + 1] AS c, 1 << i AS s FROM range(4) r(i)),
        total AS (SELECT count(*)::DOUBLE AS t FROM lineitem)
        SELECT a.c AS col_a, b.c AS col_b, x.n AS n_a, y.n AS n_b, z.n AS n_both,
               round((t * z.n - x.n::DOUBLE * y.n) / sqrt(x.n::DOUBLE * (t - x.n) * y.n * (t - y.n)), 6) AS phi
        FROM names a JOIN names b ON a.i < b.i JOIN sets x ON x.s = a.s JOIN sets y ON y.s = b.s
        JOIN sets z ON z.s = a.s + b.s, total""",
)
def missing_dependence(spark, sf_dir):
    return rounded(missingness.missing_dependence(gappy(spark, sf_dir)))


TEXTS = """(SELECT o_orderkey::VARCHAR AS as_number, strftime(o_orderdate, '%Y-%m-%d') AS as_date,
    CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_custkey::VARCHAR END AS mixed FROM orders)"""


@CHECKS.add(
    "type_consistency",
    f"""SELECT 'as_number' AS "column", count(*) AS n, 1.0::DOUBLE AS numeric_pct, 0.0::DOUBLE AS date_pct FROM orders
        UNION ALL SELECT 'as_date', count(*), 0.0, 1.0 FROM orders
        UNION ALL SELECT 'mixed', count(*), round(count(*) FILTER (WHERE mixed <> 'O') / count(*), 6),
                         0.0 FROM {TEXTS}""",
)
def type_consistency(spark, sf_dir):
    """Some numbers were typed as the letter O."""
    texts = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS as_number", "date_format(o_orderdate, 'yyyy-MM-dd') AS as_date",
        "IF(o_orderstatus = 'P', 'O', CAST(o_custkey AS STRING)) AS mixed",
    )
    found = advisories.type_consistency(texts)
    return rounded(found)


@CHECKS.add(
    "inconsistent_values",
    f"SELECT mixed AS value, count(*) AS count FROM {TEXTS} WHERE mixed = 'O' GROUP BY 1",
)
def inconsistent_values(spark, sf_dir):
    texts = table(spark, sf_dir, "orders").selectExpr(
        "IF(o_orderstatus = 'P', 'O', CAST(o_custkey AS STRING)) AS mixed"
    )
    return advisories.inconsistent_values(texts, "mixed")


@CHECKS.add(
    "row_missingness",
    f"""SELECT (discount IS NULL)::BIGINT + (tax IS NULL)::BIGINT AS n_missing, count(*) AS n_rows
        FROM {PRICED} GROUP BY 1""",
)
def row_missingness(spark, sf_dir):
    return advisories.row_missingness(priced(spark, sf_dir))


@CHECKS.add(
    "missing_patterns",
    f"""SELECT '000' || (discount IS NULL)::INT || (tax IS NULL)::INT || '00' AS pattern, count(*) AS n_rows
        FROM {PRICED} GROUP BY 1""",
)
def missing_patterns(spark, sf_dir):
    return advisories.missing_patterns(priced(spark, sf_dir))


@CHECKS.add(
    "outlier_profile",
    """SELECT coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
                       OR abs((value - m) / s) > 3, false) AS is_outlier, count(*) AS n,
              round(avg(value), 6) AS mean_value, round(avg(user_id), 6) AS mean_user_id
       FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                            avg(value) AS m, stddev_samp(value) AS s FROM events) GROUP BY 1""",
)
def outlier_profile(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rounded(outliers.outlier_profile(events, "value", ["value", "user_id"]))


@CHECKS.add(
    "stratified_sample",
    """SELECT * FROM labels WHERE ('0x' || substr(md5('3:' || doc_id), 1, 12))::BIGINT / 281474976710656.0
           < CASE WHEN toxic = 0 THEN 0.1 WHEN toxic = 1 THEN 1.0 ELSE 0 END""",
)
def stratified_sample(spark, sf_dir):
    """A tenth of the majority class and all of the minority."""
    return advisories.stratified_sample(
        table(spark, sf_dir, "labels"), "toxic", {0: 0.1, 1: 1.0}, seed=3, key=["doc_id"]
    )


@CHECKS.add(
    "sized_sample",
    """SELECT doc_id, quality, toxic FROM
           (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('5:' || doc_id)[:12], doc_id) AS place FROM labels)
       WHERE place <= CASE WHEN toxic = 0 THEN 40 WHEN toxic = 1 THEN 17 ELSE 0 END""",
)
def sized_sample(spark, sf_dir):
    """Forty of one class and seventeen of the other."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return advisories.sized_sample(labels, "toxic", {0: 40, 1: 17}, seed=5, key=["doc_id"])


# Dates in two formats, some with the letter O for a zero; codes; prices with a comma.
TYPED = """(SELECT CASE WHEN o_orderkey % 10 < 6 THEN strftime(o_orderdate, '%Y-%m-%d')
                        WHEN o_orderkey % 50 = 9 THEN replace(strftime(o_orderdate, '%Y-%m-%d'), '0', 'O')
                        ELSE strftime(o_orderdate, '%d/%m/%Y') END AS typed,
                   o_orderpriority AS code,
                   CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE replace((o_custkey * 7 / 4.0)::DECIMAL(12, 2)::VARCHAR, '.', ',') END AS price
            FROM orders)"""


def typed(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderkey % 10 < 6 THEN date_format(o_orderdate, 'yyyy-MM-dd')"
        " WHEN o_orderkey % 50 = 9 THEN replace(date_format(o_orderdate, 'yyyy-MM-dd'), '0', 'O')"
        " ELSE date_format(o_orderdate, 'dd/MM/yyyy') END AS typed",
        "o_orderpriority AS code",
        "IF(o_orderkey % 3 = 0, NULL, replace(CAST(CAST(o_custkey * 7 / 4.0 AS DECIMAL(12, 2)) AS STRING), '.', ',')) AS price",
    )


PATTERNS = f"""texts AS (SELECT unnest(['typed', 'code', 'price']) AS c, unnest([typed, code, price]) AS txt FROM {TYPED}),
    shapes AS (SELECT c, regexp_replace(regexp_replace(regexp_replace(txt, '[0-9]', '9', 'g'), '\\p{{Lu}}', 'A', 'g'),
                                        '\\p{{Ll}}', 'a', 'g') AS shape, txt FROM texts WHERE txt IS NOT NULL),
    counted AS (SELECT c, shape, regexp_replace(regexp_replace(regexp_replace(shape, '9+', '9+', 'g'), 'A+', 'A+', 'g'), 'a+', 'a+', 'g') AS run,
                       count(*) AS n, min(txt) AS example, max(txt[1:2]) AS first, max(txt[4:5]) AS second,
                       count(*) * list_sum(list_transform(regexp_extract_all(shape, '9+|A+|a+'), lambda r: 2 * log2(length(r)) + 1)) AS spread
                FROM shapes GROUP BY c, shape),
    runs AS (SELECT c, run, sum(8.0 * length(shape)) + 20 * (log2(sum(n)) - sum(n * log2(n)) / sum(n)) <= 8.0 * length(run) + 20 * sum(spread) / sum(n) AS apart
             FROM counted GROUP BY c, run),
    patterns AS (SELECT c, CASE WHEN apart THEN shape ELSE run END AS pattern, sum(n) AS n, min(example) AS example,
                        max(first) AS first, max(second) AS second FROM counted JOIN runs USING (c, run) GROUP BY ALL),
    told AS (SELECT *, n / sum(n) OVER (PARTITION BY c) AS share FROM patterns)"""


@CHECKS.add(
    "text_formats",
    f"""WITH {PATTERNS}
        SELECT c AS "column", pattern,
               CASE WHEN pattern = '9999-99-99' THEN 'yyyy-MM-dd'
                    WHEN pattern = '99/99/9999' AND first > '12' AND second <= '12' THEN 'dd/MM/yyyy'
                    WHEN regexp_full_match(pattern, '9+[+]?,9+[+]?') THEN 'decimal comma' END AS format,
               n::BIGINT AS n, round(share, 6) AS share, example, share < 0.05 AS is_off FROM told""",
)
def text_formats(spark, sf_dir):
    return rounded(formats.text_formats(typed(spark, sf_dir)))


@CHECKS.add(
    "off_format_values",
    f"""WITH {PATTERNS}
        SELECT txt AS value, pattern, count(*) AS count
        FROM shapes JOIN counted USING (c, shape) JOIN runs USING (c, run)
        JOIN told ON told.c = shapes.c AND told.pattern = CASE WHEN apart THEN shape ELSE run END
        WHERE shapes.c = 'typed' AND share < 0.05 GROUP BY ALL""",
)
def off_format_values(spark, sf_dir):
    return formats.off_format_values(typed(spark, sf_dir), "typed")
