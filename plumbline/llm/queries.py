"""The registered queries of this package and SQL that gives the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import (
    chat, exact, infill, language, licenses, mixing, near, packing, pii, pseudo, repair, sharding, syncmers,
)
from plumbline.llm.shared import table


def op1_minhash_near_dedup(spark, sf_dir):
    return near.near_groups(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark, sf_dir):
    uses = mixing.mix(table(spark, sf_dir, "documents"), max_repetition=2.0)
    return uses.withColumns({c: F.round(c, 6) for c in ("weight", "turn")})


def op3_license_scan(spark, sf_dir):
    return licenses.scan(licenses.laid_out(table(spark, sf_dir, "documents")))


def op4_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return rows.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_fingerprints(spark, sf_dir):
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op9_personal_data(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark, sf_dir):
    return pseudo.score(table(spark, sf_dir, "documents"))


def op11_infilling(spark, sf_dir):
    cut = infill.infill(table(spark, sf_dir, "documents"), fim_rate=100, spm_rate=50)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(infill.restored()).alias("restored_sha256"),
    )


def op12_chat_format(spark, sf_dir):
    conversations = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_turns(conversations))


def op13_structure_repair(spark, sf_dir):
    return repair.digests(repair.repair(repair.damaged(table(spark, sf_dir, "conversations"))))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_source_mixing,
        op3_license_scan,
        op4_exact_dedup,
        op5_packing,
        op6_language_id,
        op7_sharding,
        op8_fingerprints,
        op9_personal_data,
        op10_lm_scoring,
        op11_infilling,
        op12_chat_format,
        op13_structure_repair,
        pipeline,
    )
}
ORACLES = {
    "op1_minhash_near_dedup": near.NEAR_SQL,
    "op2_source_mixing": mixing.MIX_SQL,
    "op3_license_scan": licenses.scan_sql(),
    "op4_exact_dedup": exact.EXACT_SQL,
    "op11_infilling": infill.INFILL_SQL,
    "op12_chat_format": chat.CHAT_SQL,
    "op13_structure_repair": repair.REPAIR_SQL,
}
