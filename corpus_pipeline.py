"""Corpus pipeline: quality rules, language ID, exact dedup, near-duplicate removal, best-fit packing.

Near duplicates are judged on shingles of five words at a similarity of 0.8; of exact copies the largest doc_id stays,
of near copies the smallest.

Edge cases: rows with null or empty text fail the quality rules; a null lang or source is a group of its own there, and
without a training label no document has a language; rows that repeat with the same id and text are copies, of which one
stays; ties are those of the operators; very long texts are judged, compared and packed whole; columns beside those of
documents, also with clashing names, are dropped; empty tables go through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact, langid, minhash, packing, quality
from quillspark.llm.common import DOC_COLUMNS, materialize, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, DOC_COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, DOC_COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first(docs, DOC_COLUMNS, exact.LsmParams(keep="max"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, DOC_COLUMNS, minhash.MinHashParams(words=5, percent=80))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("best_fit_packing", packing_stage),
]

#: Quantile sketches, mixture inference, sketching and packing have no SQL form; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's rows are written to the shared folder before the next one reads them."""
    docs, table = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
            if table is not None:
                release(table)
            table = docs
    return docs
