"""Exact duplicates against plain Python: several levels, both identifiers, filters that are read, colliding digests, edge rows."""

import hashlib
from collections import defaultdict

import pytest

from quillspark.llm import exact

SF = "/root/testdata/sf0.001"


def brute(rows, keep):
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    best = max if keep == "max" else min
    return sorted((d, best(v), len(v), d == best(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in by.items() for d in v)


@pytest.mark.parametrize("keep,runs,fan", [("max", 4, 2), ("min", 5, 2), ("max", 6, 3), ("min", 1, 2)])
def test_levels_against_plain_python(spark, keep, runs, fan):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = exact.exact_dedup(docs, exact.LsmParams(keep=keep, runs=runs, fan=fan)).collect()
    assert sorted(map(tuple, got)) == brute([(r.doc_id, r.text) for r in docs.collect()], keep)


def test_filters_spare_the_merge_of_single_digests(spark, monkeypatch):
    """With filters that are never set nothing is merged; with the real ones everything that must be is, and little else."""
    rows = [(i, f"text {i % 300}" if i < 600 else f"single {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = exact._merged
    monkeypatch.setattr(exact, "_merged", lambda rows, keep, n, p: (seen.append(rows.count()), real(rows, keep, n, p))[1])
    got = exact.exact_dedup(docs).collect()
    assert sorted(map(tuple, got)) == brute(rows, "max")
    assert seen[0] == 2000 and all(n < 700 for n in seen[1:])  # 1700 digests, of which 300 occur twice
    monkeypatch.setattr(exact, "_looked_up", lambda rows, bits: rows.withColumn("hit", exact.F.lit(False)))
    blind = exact.index(docs.select("doc_id", exact.F.col("doc_id").alias("uid"), exact.F.unhex(exact.F.sha2("text", 256)).alias("digest")), exact.LsmParams())
    assert blind.count() > blind.select("digest").distinct().count()


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: exact.F.lit("00" * 32))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"), (6, None), (7, "")]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:4] for r in got) == [x[:4] for x in brute(rows, "max")]


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x", "c"), (3, "x", "d"), (None, "x", "e"), (4, "word " * 50_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT string")
    for keep, best in (("max", 2), ("min", 1)):
        got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(docs, exact.LsmParams(keep=keep)).collect())
        assert [g[:3] for g in got] == [(0, 3, 3), (1, best, 2), (2, best, 2), (3, 3, 3), (3, 3, 3), (4, 4, 1)]
        assert sum(g[3] for g in got if g[0] in (0, 3)) == 1 and not got[0][3]
        kept = exact.keep_first(docs, ("doc_id", "text"), exact.LsmParams(keep=keep)).collect()
        assert sorted(r.doc_id for r in kept) == [best, 3, 4]
    assert exact.exact_dedup(docs.limit(0)).count() == 0 and exact.keep_first(docs.limit(0), ("doc_id",)).count() == 0
