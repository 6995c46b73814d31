"""Each stage of the pipeline on what its predecessor kept, recomputed in plain Python; whole rows; edge rows."""

import math

import pytest
import test_exact
import test_langid
import test_near_dedup
import test_quality

import corpus_pipeline
from quillspark.llm import langid, quality, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """The rows that go into each stage and, last, those that the whole pipeline returns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_names_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "exact_dedup", "near_dedup", "best_fit_packing"]
    for before, after in zip(steps[:4], steps[1:5]):
        assert after.columns == COLUMNS
        a, b = rows(before), rows(after)
        assert 0 < len(b) <= len(a) and all(a[d] == v for d, v in b.items())  # whole rows, and no others


def test_quality_stage(steps):
    """What the base rules reject goes, what they keep stays unless its counts lie beyond thresholds of exact quantiles."""
    counted = [r.asDict() for r in quality.measure(steps[0]).select("doc_id", "lang", "source", *quality.COUNTS, "n_upper", "n_lines").collect()]
    p, fine = quality.QualityParams(), [r for r in counted if not test_quality.base_failed(r)]
    assert len(fine) < p.min_group  # every group borrows from all
    kept = set(rows(steps[1]))
    assert kept <= {r["doc_id"] for r in fine}
    g, sure = p.gamma + 1e-9, 0
    for r in fine:
        verdicts = set()
        for x in (g, 1 / g):
            bad = False
            for q in quality.RATIOS:
                v = sorted(test_quality.ratio(q, f) for f in fine)
                at = lambda s: v[math.ceil(s * len(v)) - 1]  # noqa: B023, E731
                hi = at(p.body) * max(x, 1) * (1 + p.reach) - p.reach * at(0.5) / min(x, 1)
                lo = at(1 - p.body) / max(x, 1) * (1 + p.reach) - p.reach * at(0.5) * min(x, 1)
                n = r[q.count]
                bad |= n - hi * max(r[q.size], 1) > p.sigmas * math.sqrt(n) if q.events else not lo <= test_quality.ratio(q, r) <= hi
            verdicts.add(bad)
        if len(verdicts) == 1:
            sure += 1
            assert (r["doc_id"] in kept) != verdicts.pop()
    assert sure > 0.9 * len(fine)


def test_language_stage(steps):
    """A document stays if it has letters and a language holds at least half of it; languages by plain likelihoods."""
    before, kept = rows(steps[1]), set(rows(steps[2]))
    model = langid.train(steps[1].where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0"), langid.LangParams())
    verdict = {r.doc_id: r for r in langid.predict(steps[1], model, langid.LangParams()).collect()}
    assert kept == {d for d, v in verdict.items() if v.lang_pred != "und" and v.score >= 0.5}
    assert all(test_langid.words(before[d][1]) for d in kept)
    assert len(kept) >= 0.97 * len(before)  # the documents here are in one language each


def test_exact_stage(steps):
    before = [(d, v[1]) for d, v in rows(steps[2]).items()]
    assert set(rows(steps[3])) == {x[0] for x in test_exact.brute(before, "max") if x[3]}


def test_near_stage(steps):
    before = [(d, v[1]) for d, v in rows(steps[3]).items()]
    assert set(rows(steps[4])) == {d for d, (_, root) in test_near_dedup.brute(before, 5, 80).items() if d == root}


def test_packing_stage_and_run(spark, steps):
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in steps[5].collect()} == set(rows(steps[4]))
    pieces = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert pieces(got) == pieces(steps[5].collect())
    load = {}
    for r in got:
        load[r.sequence_id] = load.get(r.sequence_id, 0) + r.length
    assert max(load.values()) <= 4096


def test_edge_rows_through_every_stage(spark):
    text = " ".join(f"the word{chr(97 + i % 26)}{chr(97 + i // 26)} and" for i in range(60))
    data = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (3, text, "en", None, 5, "c"), (3, text, "en", None, 5, "d"), (None, text + " end", None, "s", None, "e"), (4, "word " * 50_000, "en", "s", 1, "f")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, TEXT string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF).collect()
        ids = sorted(r.doc_id or 0 for r in got)
        assert ids == {"quality_rules": [0, 3, 3], "language_id": [0, 3, 3, 4], "exact_dedup": [0, 2, 3, 4], "near_dedup": [1, 2, 3, 4]}[name], name
        assert all(r.__fields__ == COLUMNS for r in got)
        assert stage(spark, docs.limit(0), SF).columns == COLUMNS and stage(spark, docs.limit(0), SF).count() == 0
    assert len(corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()) > 6
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), SF).count() == 0


def test_registered_queries():
    assert sorted(queries.queries()) == sorted(["op1_quality_rules", "op2_sharding", "op3_best_fit_packing", "op4_html_extraction", "op5_lm_scoring", "op6_minhash_near_dedup", "op7_exact_dedup", "op8_byte_bpe", "op9_language_id", "op10_license_scan"])
