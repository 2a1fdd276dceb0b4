"""The corpus pipeline, stage by stage, and the registered queries against their SQL."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from cases import SF_DIR, none, odd, table

from plumbline.llm import queries
from test_dedup import brute_components

def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")

def test_stages_against_brute_force(spark):
    docs = documents(spark)
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in table(docs)}

    kept = stages["language"](spark, docs, SF_DIR)
    assert kept.columns == names
    assert {r["doc_id"] for r in table(kept)} == {d for d, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}

    unique = stages["exact_dedup"](spark, docs, SF_DIR)
    first = {}
    for d in sorted(rows):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[d]["text"] or ""), d)
    assert unique.columns == names and sorted(r["doc_id"] for r in table(unique)) == sorted(first.values())

    apart = stages["near_dedup"](spark, unique, SF_DIR)
    texts = [(d, rows[d]["text"]) for d in first.values()]
    want = sorted(d for d, (_, c) in brute_components(texts).items() if c == d)
    assert apart.columns == names and sorted(r["doc_id"] for r in table(apart)) == want

    mixture = table(stages["mixing"](spark, apart, SF_DIR))
    uses = Counter(r["doc_id"] for r in mixture)
    assert set(uses) == set(want) and max(uses.values()) == 2
    assert all(r == rows[r["doc_id"]] for r in mixture)

def test_run(spark):
    found = table(corpus_pipeline.run(spark, SF_DIR))
    places = {(r["bucket"], r["batch"], r["slot"]) for r in found}
    assert len(places) == len(found) > 100

def test_odd_and_empty(spark):
    for docs in (odd(spark), none(spark)):
        n = docs.count()
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, docs, SF_DIR)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= (n > 0)

def same(value):
    return float(value) if isinstance(value, float) else value

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    con = duckdb.connect()
    for view in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{SF_DIR}/{view}.parquet'")
    columns = sorted(found.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {listed} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(same(r[c]) for c in columns) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [tuple(map(same, r)) for r in want]))

def test_no_rows_are_lost(spark):
    n = documents(spark).count()
    for name in ("op6_language_id", "op7_sharding", "op8_fingerprints", "op9_personal_data", "op10_lm_scoring", "op5_packing"):
        assert queries.QUERIES[name](spark, SF_DIR).count() == n

