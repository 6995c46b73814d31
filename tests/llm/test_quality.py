"""Thresholds against exact quantiles, verdicts against plain Python, merging, edge rows."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def counted(docs):
    rows = quality.measure(docs).select("doc_id", "lang", "source", *quality.COUNTS, "n_upper", "n_lines").collect()
    return [r.asDict() for r in rows]


def base_failed(r):
    return r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]


def ratio(q, r):
    return r[q.count] / max(r[q.size], 1)


@pytest.mark.parametrize("min_group", [25, 100, 10**6])
def test_verdicts_against_exact_quantiles(docs, counted, min_group):
    """Thresholds within the sketch's error of those of exact quantiles; rows inside that margin of error may differ."""
    p = quality.QualityParams(min_group=min_group)
    fine, lang, whole = defaultdict(list), defaultdict(list), []
    for r in counted:
        if not base_failed(r):
            fine[r["lang"], r["source"]].append(r)
            lang[r["lang"]].append(r)
            whole.append(r)
    g = p.gamma + 1e-9

    def limits(q, rows, sign):
        """hi and lo moved outwards (sign 1) or inwards (-1) by what the sketch may be wrong."""
        v = sorted(ratio(q, r) for r in rows)
        at = lambda x: v[math.ceil(x * len(v)) - 1]
        low, mid, high = at(1 - p.body), at(0.5), at(p.body)
        if sign > 0:
            return high * g * (1 + p.reach) - p.reach * mid, low / g * (1 + p.reach) - p.reach * mid
        return high * (1 + p.reach) - p.reach * mid * g, low * (1 + p.reach) - p.reach * mid / g

    def rejected(r, sign):
        own = fine[r["lang"], r["source"]]
        rows = own if len(own) >= min_group else lang[r["lang"]] if len(lang[r["lang"]]) >= min_group else whole
        for q in quality.RATIOS:
            hi, lo = limits(q, rows, sign)
            if q.events and r[q.count] - hi * max(r[q.size], 1) > p.sigmas * math.sqrt(r[q.count]):
                return True
            if not q.events and (ratio(q, r) > hi or ratio(q, r) < lo):
                return True
        return False

    got = {r.doc_id: r.kept for r in quality.judge(docs, p).collect()}
    sure = 0
    for r in counted:
        if base_failed(r):
            assert not got[r["doc_id"]]
        elif rejected(r, 1) == rejected(r, -1):
            sure += 1
            assert got[r["doc_id"]] == (not rejected(r, 1)), r
    assert sure > 0.95 * sum(not base_failed(r) for r in counted) and len(got) == len(counted)
    assert 0 < sum(got.values()) < sum(not base_failed(r) for r in counted)


def test_merged_sketches_equal_the_sketch_of_all(docs):
    m = quality.measure(docs)
    p = quality.QualityParams()
    parts = quality.sketch(m.where("doc_id % 2 = 0"), p).unionByName(quality.sketch(m.where("doc_id % 2 = 1"), p))
    merged = parts.groupBy("lang", "source", "ratio", "cell").agg(F.sum("n").alias("n"))
    assert merged.exceptAll(quality.sketch(m, p)).count() == 0 and merged.count() == quality.sketch(m, p).count()


def test_runs_agree_and_clean_documents_stay(spark, docs):
    a = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    b = {r.doc_id: (r.kept, r.base_failed) for r in quality.judge(docs.repartition(7)).collect()}
    assert a == {k: v[0] for k, v in b.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passing = [d for d, v in b.items() if not v[1]]
    clean, junk = [[a[d] for d in passing if labels.get(d) == q] for q in (1, 0)]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_edge_rows(spark):
    text = "some words here. " * 2 + " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, text, "en", None), (3, text, "en", None), (None, text, None, "a"), (4, "# " * 200 + text, "en", "a"), (5, "word " * 50_000, "en", "a")]
    docs = spark.createDataFrame([(*r, False, 9) for r in rows], "doc_id long, text string, lang string, source string, kept boolean, N_WORDS int")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality.judge(docs).collect())
    assert [g[:3] for g in got] == [(0, 66, False), (1, 0, True), (2, 0, True), (3, 66, False), (3, 66, False), (4, 266, True), (5, 50_000, True)]
    assert [g[3] for g in got] == [True, False, False, True, True, False, False]
    assert quality.judge(docs.limit(0)).count() == 0 and quality.judge(docs.where("doc_id < 3")).where("kept").count() == 0
    kept = quality.quality_filter(docs, ("doc_id", "text", "lang", "source", "n_chars"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 3
