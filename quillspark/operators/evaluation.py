"""Character and word error rates, corpus report, release gate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import eval_normalize

#: Fixed weights of the twelve sub-scores.
WEIGHTS = {"unicode": 0.10, "char": 0.10, "word": 0.10, "paragraph": 0.08, "reading_order": 0.10, "rtl": 0.08, "heading": 0.08, "list": 0.06, "table": 0.08, "ocr": 0.08, "mixed_script": 0.07, "markdown": 0.07}


def character_errors(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis)


def error_rate(errors: Column, reference_count: Column, hypothesis_count: Column) -> Column:
    """Errors by reference length; an empty reference is 0 or, with a hypothesis, 1."""
    return F.when(reference_count == 0, F.when(hypothesis_count == 0, 0.0).otherwise(1.0)).otherwise(errors / reference_count)


EDITS = StructType([StructField(n, IntegerType()) for n in ("errors", "substitutions", "deletions", "insertions")])


def count_edits(ref: list, hyp: list) -> tuple[int, int, int, int]:
    """errors, substitutions, deletions, insertions; of equal cost a substitution is taken before a deletion before an insertion."""
    number: dict = {}
    x, y = ([number.setdefault(w, len(number)) for w in words] for words in (ref, hyp))
    y, at = np.array(y, np.int64), np.arange(len(y) + 1)
    cost, subs = at.copy(), np.zeros(len(at), np.int64)
    for w in x:  # a row of the matrix at once
        miss = (y != w).astype(np.int64)
        diag, down = cost[:-1] + miss, cost[1:] + 1
        take = diag <= down
        own = np.r_[cost[0] + 1, np.where(take, diag, down)] - at
        s = np.r_[0, np.where(take, subs[:-1] + miss, subs[1:])]
        least = np.minimum.accumulate(own)  # insertions: from the last cell to the left that is no dearer
        cost, subs = least + at, s[np.maximum.accumulate(np.where(own == least, at, 0))]
    errors, s = int(cost[-1]), int(subs[-1])
    gone = (errors - s + len(x) - len(y)) // 2
    return errors, s, gone, errors - s - gone


@F.pandas_udf(EDITS)
def word_edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Word edits of whole texts; null counts as empty."""
    return pd.DataFrame([count_edits((a or "").split(), (b or "").split()) for a, b in zip(ref, hyp)], columns=["errors", "substitutions", "deletions", "insertions"])


def with_reference(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, item_id, a, b: whole text and reference, null as empty. Every row of items (item_id, text) serves; no document is left out."""
    order = Window.orderBy("item_id")
    refs = items.select(F.row_number().over(order).alias("k"), "item_id", F.coalesce("text", F.lit("")).alias("b"))
    n = max(items.count(), 1)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("a"), (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(n)) + 1).alias("k"))
    small = n <= 100_000 and (refs.agg(F.sum(F.octet_length("b"))).first()[0] or 0) <= 64 << 20
    return docs.join(F.broadcast(refs) if small else refs, "k", "left").select("doc_id", "item_id", "a", F.coalesce("b", F.lit("")).alias("b"))


@F.pandas_udf(EDITS)
def character_edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Character edits of whole texts; null counts as empty."""
    return pd.DataFrame([count_edits(list(a or ""), list(b or "")) for a, b in zip(ref, hyp)], columns=["errors", "substitutions", "deletions", "insertions"])


def evaluate(pairs: DataFrame, max_cer: float = 0.05) -> DataFrame:
    """pairs (filename, reference, hypothesis) -> filename, cer, wer, reference_chars, substitutions, deletions, insertions,
    passed. Texts are normalised first; null counts as empty. The word error rate is reported, the character rate decides."""
    own = lambda c: eval_normalize(F.coalesce(F.col(c), F.lit("")))
    t = pairs.select("filename", own("reference").alias("r"), own("hypothesis").alias("h"))
    t = t.select("filename", "r", "h", character_edits("r", "h").alias("c"), word_edits("r", "h").alias("w"))
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda x: x != ""))
    t = t.withColumn("cer", error_rate(F.col("c.errors"), F.length("r"), F.length("h"))).withColumn("wer", error_rate(F.col("w.errors"), words("r"), words("h")))
    return t.select("filename", "cer", "wer", F.length("r").alias("reference_chars"), "c.substitutions", "c.deletions", "c.insertions", (F.col("cer") <= max_cer).alias("passed"))


def corpus_report(scored: DataFrame) -> DataFrame:
    """scored (cer, wer, passed) -> files, mean_cer, mean_wer, passed, all_passed; without files nothing has passed."""
    out = scored.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.avg("cer"), F.lit(0.0)).alias("mean_cer"), F.coalesce(F.avg("wer"), F.lit(0.0)).alias("mean_wer"), F.count_if("passed").alias("passed"))
    return out.withColumn("all_passed", (F.col("files") > 0) & (F.col("files") == F.col("passed")))


#: Sub-scores that must reach GATE each; the composite must reach GATE_ALL.
GATED, GATE, GATE_ALL = ("unicode", "char", "word", "reading_order", "rtl", "table", "markdown"), 0.90, 0.95


def release_gate(scores: dict[str, Column]) -> Column:
    """The composite and the gated sub-scores are high enough; a null score fails."""
    out = composite(scores) >= GATE_ALL
    for k in GATED:
        out = out & (scores[k] >= GATE)
    return F.coalesce(out, F.lit(False))


def complexity(fonts: Column, pages: Column, found_tables: Column, rtl_percent: Column, media: Column) -> Column:
    """0 to 100 from fonts on pages, tables, columns, right-to-left share, and pictures."""
    font = F.when(fonts > 0, F.least(fonts / pages * 20.0, F.lit(20.0))).otherwise(5.0)
    whole = font + F.least(found_tables * 5.0, F.lit(25.0)) + F.when(pages > 0, 10.0).otherwise(0.0) + F.least(rtl_percent / 100.0 * 25.0, F.lit(25.0)) + F.least(F.greatest(media * 2.0, F.lit(0.0)), F.lit(20.0))
    return F.least(F.round(whole), F.lit(100.0))


def composite(scores: dict[str, Column]) -> Column:
    return F.round(sum((scores[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)), 3)
