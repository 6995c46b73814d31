"""Shards against a plain greedy packing, whole groups, balance of all three weights, edge rows."""

import collections
import zlib

import numpy as np
import pytest

from quillspark.llm import sharding

SF = "/root/testdata/sf0.01"


def weights(text):
    return len(text.encode()) + 8, len(text.encode().split()), 1


def check(docs, got, shards, params):
    """Groups lie whole, shards are near equal in bytes and rows, slots are gapless."""
    of = collections.defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
    by_text, load, total = collections.defaultdict(set), np.zeros((shards, 3)), np.zeros(3)
    count = collections.Counter(t for _, t in docs)
    for d, t in docs:
        r = of[d].pop()
        by_text[t].add(r.shard)
        load[r.shard] += weights(t)
        total += weights(t)
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (weights(t)[0], zlib.crc32(t.encode()), "bytes", None)
    for t, where in by_text.items():
        if (np.array(weights(t)) * count[t] <= total / shards).all():
            assert len(where) == 1, (t[:40], count[t])
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


@pytest.mark.parametrize("share", [200, 1])
def test_groups_lie_whole_and_shards_balance(spark, share):
    """share 200: every group is an item; share 1: nearly all are placed by their class."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    load = check(rows, sharding.shard(docs, sharding.ShardParams(share=share, rows_a_run=7)).collect(), 24, share)
    spread = load.max(axis=0) / load.mean(axis=0) - load.min(axis=0) / load.mean(axis=0)
    assert spread[0] < (0.01 if share == 200 else 0.1) and spread[1] < 0.15 and spread[2] < 0.25, spread


def test_only_what_no_shard_can_hold_is_cut(spark):
    rows = [(i, "copy of one text") for i in range(400)] + [(400 + i, "another " * 3) for i in range(20)] + [(1000 + i, f"own text {i} " + "x " * (i % 50)) for i in range(800)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), sharding.ShardParams(shards=8)).collect()
    load = check(rows, got, 8, 200)
    assert len({r.shard for r in got if r.doc_id < 400}) >= 2 and load[:, 0].max() / load[:, 0].min() < 1.05


def test_place_against_plain_greedy():
    r = np.random.default_rng(1)
    for _ in range(20):
        v = r.integers(1, 100, (60, 3)).astype(float)
        total, free, want = v.sum(axis=0).tolist(), [[1 / 5] * 3 for _ in range(5)], []
        for row in v.tolist():
            x = [a / t for a, t in zip(row, total)]
            dots = [sum(a * b for a, b in zip(f, x)) for f in free]
            k = max(range(5), key=lambda j: (round(dots[j], 12), -j))
            want.append(k)
            free[k] = [f - a for f, a in zip(free[k], x)]
        assert sharding.place(v, 5).tolist() == want


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x", "c"), (3, "x", "d"), (None, "x", "e"), (4, "word " * 50_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SHARD string")
    got = sharding.shard(docs).collect()
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in got) == [(0, 9, zlib.crc32(b"x")), (1, 8, 0), (2, 8, 0), (3, 9, zlib.crc32(b"x")), (3, 9, zlib.crc32(b"x")), (4, 250_008, zlib.crc32(b"word " * 50_000))]
    assert sharding.shard(docs.limit(0)).count() == 0
    assert {r.shard for r in sharding.shard(docs, sharding.ShardParams(shards=1)).collect()} == {0}
