"""Near duplicates against all pairs: near groups, torn buckets, several blocks, edge rows."""

import random

import numpy as np
import pytest

from quillspark.llm import minhash

SF = "/root/testdata/sf0.001"


def brute(rows, k, percent):
    """doc_id -> (set size, smallest linked id) by all pairs of (doc_id, text)."""
    sets, root = {}, {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d], root[d] = frozenset(zip(*[w[i:] for i in range(min(k, len(w)))])) if w else frozenset(), d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed, groups, members, words, edits):
    """Groups of texts that differ from a first one by up to ``edits`` changed words: some pairs reach 0.8, some don't."""
    r, out = random.Random(seed), []
    for g in range(groups):
        first = [f"w{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(members):
            text = list(first)
            for _ in range(r.randrange(edits)):
                text[r.randrange(words)] = f"x{r.randrange(10**6)}"
            out.append((len(out), " ".join(text)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("edits,block", [(5, 2048), (24, 2048), (24, 16)])
def test_groups_of_near_copies(spark, edits, block):
    rows = near_copies(edits, 3, 60, 100, edits)
    want = brute(rows, 2, 80)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.MinHashParams(words=2, block=block)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_grow_with_the_members_of_a_group(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(minhash, "components", lambda links, f=minhash.components: (seen.append(links.count()), f(links))[1])
    for n in (100, 200):
        minhash.near_duplicates(spark.createDataFrame(near_copies(1, 1, n, 200, 6), "doc_id long, text string"), minhash.MinHashParams(words=2)).count()
    assert max(seen) <= 2 * 200 and max(seen) <= 2.5 * max(seen[:1])


def test_forest_joins_what_the_links_join():
    r = np.random.default_rng(3)
    for _ in range(50):
        label = r.integers(0, 9, 30)
        near = np.triu(r.random((30, 30)) < 0.03, 1)
        near = near | near.T
        near &= label[:, None] != label[None, :]

        def parts(pairs):
            root = dict(zip(label.tolist(), label.tolist()))
            for a, b in pairs:
                x, y = sorted((root[label[a]], root[label[b]]))
                root = {k: x if v == y else v for k, v in root.items()}
            return root

        i, j = minhash._forest(near, label)
        assert near[i, j].all() and parts(zip(i, j)) == parts(zip(*np.nonzero(near)))
        assert len(i) == len(set(label)) - len(set(parts(zip(i, j)).values()))


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t", "c"), (4, "one", "d"), (5, "ONE", "e"), (7, "a b c", "f"), (7, "a b c", "g"), (None, "a b c", "h"), (8, "word " * 50_000, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, minhash.MinHashParams(words=2)).collect())
    assert got == [(0, 2, 7, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (7, 2, 7, True), (7, 2, 7, True), (8, 1, 8, True)]
    kept = minhash.keep_one(docs, ("doc_id", "text"), minhash.MinHashParams(words=2)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 7, 8]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.keep_one(docs.limit(0), ("doc_id",)).count() == 0
