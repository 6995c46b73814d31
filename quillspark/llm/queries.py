"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from . import bpe, exact, html_extract, langid, licenses, lm, minhash, packing, quality, sharding


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality.judge(_table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"), sharding.ShardParams(shards=24))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), packing.PackParams(capacity=4096, end_id=1))


def op4_html_extraction(spark, sf_dir):
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark, sf_dir):
    return lm.lm_scores(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.MinHashParams(words=2, percent=80))


def op7_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(_table(spark, sf_dir, "documents"), exact.LsmParams(keep="max"))


def op8_byte_bpe(spark, sf_dir):
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def queries():
    own = (op1_quality_rules, op2_sharding, op3_best_fit_packing, op4_html_extraction, op5_lm_scoring,
           op6_minhash_near_dedup, op7_exact_dedup, op8_byte_bpe, op9_language_id, op10_license_scan)
    return {f.__name__: f for f in own}


#: Equal texts by the text itself; ties of the kept row cannot occur, as doc_id is unique in the table.
OP7 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


def oracle_sql():
    return {"op7_exact_dedup": OP7}
