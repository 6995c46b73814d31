"""The class model against plain Python, the exchange against whole likelihoods, edge rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lm
from quillspark.llm.common import crc_bucket

SF = "/root/testdata/sf0.001"
SMALL = {"head": 3000, "seed": 60, "classes": 12, "buckets": 5, "dense": 40, "endings": 32}


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module", params=[{}, SMALL], ids=["production", "small"])
def model(request, docs):
    """Production parameters and small ones, which reach words without a number, several buckets and sparse counts."""
    p = lm.BrownParams(**request.param)
    rows = docs.select("doc_id", "text", (crc_bucket(F.col("doc_id"), 7) == 2).alias("held"))
    return p, lm.train(rows.withColumn("uid", F.monotonically_increasing_id()), p)


def test_scores_against_plain_python(docs, model):
    """Everything but the classes is counted again: base, transitions, class sizes, unseen words, log probabilities."""
    p, m = model
    rows = [(r.doc_id, words(r.text), zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in docs.collect()]
    count = Counter(w for _, ws, held in rows if not held for w in [*ws, b""])
    cls = dict(zip(m["words"].value, m["of"].tolist())) | {bytes(r.word): r.cls for r in m["tail"].collect()}
    assert set(cls) == set(count) and cls[b""] == 0 and all(v > 0 for w, v in cls.items() if w)  # every training word has a learned class
    size, total = len(count), sum(count.values())

    def of(w):
        return cls[w] if w in cls else int(m["endings"][zlib.crc32(w.decode()[-2:].encode()) % p.endings])

    trans = Counter()
    for _, ws, held in rows:
        if not held:
            k = [0, *map(of, ws), 0]
            trans.update(zip(k, k[1:]))
    tokens, kinds, after = Counter(), Counter(), Counter()
    for w, n in count.items():
        tokens[cls[w]] += n
        kinds[cls[w]] += 1
    for (a, _), n in trans.items():
        after[a] += n
    marginal = {k: (tokens[k] + 1) / (total + p.classes) for k in range(p.classes)}
    got = {r.doc_id: r for r in lm.score(m).collect()}
    for d, ws, held in rows:
        base = sum(math.log10((count[w] + 1) / (total + size + 1)) for w in [*ws, b""])
        k, want = [0, *map(of, ws), 0], 0.0
        for a, b, w in zip(k, k[1:], [*ws, b""]):
            want += math.log10((trans[a, b] + p.alpha * marginal[b]) / (after[a] + p.alpha))
            want += math.log10((count[w] + 1) / (tokens[b] + kinds[b] + 1)) if w else 0.0
        g = got[d]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held, len(ws) + 1, sum(w in count for w in [*ws, b""]), total)
        assert abs(g.base_score - base) < 1e-6 * abs(base) and abs(g.score - want) < 1e-6 * abs(want)


def test_class_model_beats_base_and_scattered_classes(docs, model):
    _, m = model
    held = [r for r in lm.score(m).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_sweeps_raise_the_likelihood(spark):
    r = np.random.default_rng(5)
    kinds = [r.integers(1, 400, 3000) * 4 + i for i in range(4)]  # four kinds of words that follow one another
    rows = [(d, " ".join(f"w{kinds[i % 4][(d * 37 + i * 11) % 3000]}" for i in range(200)), False, d) for d in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean, uid long")
    found = {}
    for sweeps in (0, 4):
        m = lm.train(docs, lm.BrownParams(seed=30, classes=6, sweeps=sweeps, buckets=3))
        ids = lm.numbered(docs.select("uid", "doc_id", F.col("text").cast("binary").alias("text"), "held"), m["words"])
        found[sweeps] = lm.likelihood(lm._transitions(ids, np.append(m["of"], -1).astype(np.int16), 6))
    assert found[4] >= found[0]
    of = dict(zip(m["words"].value, m["of"].tolist()))
    by_kind = [Counter(of[w] for w in of if w and int(w[1:]) % 4 == i) for i in range(4)]
    assert sum(c.most_common(1)[0][1] for c in by_kind) > 0.9 * sum(map(Counter.total, by_kind))


def test_gains_are_differences_of_the_likelihood():
    r = np.random.default_rng(2)
    for _ in range(20):
        n, c = 12, 4
        w = r.integers(0, 6, (n, n)) * (r.random((n, n)) < 0.5)
        of = np.append(0, r.integers(1, c, n - 1))

        def whole(of):
            one = np.eye(c)[of]
            return lm.likelihood(one.T @ w @ one)

        one = np.eye(c)[of]
        right, left, m = w @ one, w.T @ one, one.T @ w @ one
        i = np.arange(1, n)
        own = np.diag(w)[i].astype(float)
        rr, ll = right[i].copy(), left[i].copy()
        rr[np.arange(n - 1), of[i]] -= own
        ll[np.arange(n - 1), of[i]] -= own
        g = lm.gains(rr, ll, own, m, of[i])
        for row, word in enumerate(i):
            for k in range(1, c):
                moved = of.copy()
                moved[word] = k
                assert abs((g[row, k] - g[row, of[word]]) - (whole(moved) - whole(of))) < 1e-8
        # and for a word that no class has yet
        word = 3
        out = of.copy()
        out[word] = c  # a class of its own, outside
        one = np.eye(c + 1)[out][:, :c]
        g = lm.gains((w @ one)[[word]], (w.T @ one)[[word]], np.array([float(w[word, word])]), one.T @ w @ one)[0]
        for k in range(2, c):
            a, b = of.copy(), of.copy()
            a[word], b[word] = k, 1
            assert abs((g[k] - g[1]) - (whole(a) - whole(b))) < 1e-8


def test_exchange_finds_the_classes_of_a_clear_case():
    of = np.append(0, 1 + np.arange(40) % 4)
    w = np.zeros((41, 41), int)
    for a in range(41):
        for b in range(41):
            if of[a] and of[b] and of[b] == of[a] % 4 + 1:
                w[a, b] = 5
    got = lm.exchange(w, 5, 20)
    assert all(len({got[i] for i in range(1, 41) if of[i] == k}) == 1 for k in range(1, 5))


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "a b a b c", "c"), (3, "a b a b c", "d"), (None, "a B \t c", "e"), (4, "word " * 50_000, "f"), (9, "unseen words é", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE string")
    got = sorted(((r.doc_id or 0, r.n_tokens) for r in lm.lm_scores(docs).collect()))
    assert got == [(0, 4), (1, 1), (2, 1), (3, 6), (3, 6), (4, 50_001), (9, 4)]
    assert all(r.score <= 0 and r.base_score <= 0 and r.n_known <= r.n_tokens for r in lm.lm_scores(docs).collect())
    assert lm.lm_scores(docs.limit(0)).count() == 0
    held = [d for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    alone = lm.lm_scores(spark.createDataFrame([(d, "a b") for d in held], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in alone] == [(0, 0, 0.0)] * 2


def test_words_of_any_bytes():
    """words come from whole columns, as Python's own split and lower give them for one text."""
    r = np.random.default_rng(6)
    raw = [bytes(r.choice([*range(256), *b" \t\n\x0b\x0c\r" * 20], r.integers(0, 60)).astype(np.uint8)) for _ in range(2000)]
    raw += [b"", b" ", b"\x1c\x1d\x1e\x1f\x85\xa0", "É ß x y İ".encode(), None, b"  a", b"b  "]
    for texts in (raw, [None, b"", b" "], []):
        flat, at = lm._words(pa.array([b"skip", *texts, b"last one"], pa.binary()).slice(1, len(texts)))
        flat = flat.to_pylist()
        assert [flat[a:b] for a, b in zip(at[:-1], at[1:])] == [words_of_bytes(t) for t in texts]


def words_of_bytes(raw):
    return (raw or b"").lower().split()


@pytest.mark.parametrize("flush", [3, 500, 1_000_000])
def test_word_counts_and_numbers(spark, docs, flush):
    """Counts sent on early, late and never; numbers and the words without one, in order."""
    want, rows = Counter(), [(r.doc_id, words(r.text)) for r in docs.collect()]
    for _, ws in rows:
        want.update([*ws, b""])
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    got = lm.word_counts(texts, flush).collect()
    assert len(got) == len(want) and {bytes(x.word): x.n for x in got} == want
    known = [b"", *(w for w, n in want.items() if w and n > 3)]
    number = {w: i for i, w in enumerate(known)}
    frame = docs.select(F.col("doc_id").alias("uid"), "doc_id", F.col("text").cast("binary").alias("text"), F.lit(False).alias("held"))
    found = {x.doc_id: x for x in lm.numbered(frame, spark.sparkContext.broadcast(known)).collect()}
    for d, ws in rows:
        assert np.frombuffer(bytes(found[d].ids), "<i4").tolist() == [number.get(w, -1) for w in ws]
        assert list(map(bytes, found[d].tail)) == [w for w in ws if w not in number]


def test_words_seen_once_in_one_place_are_decided_once(monkeypatch):
    """the gains of a place are the same for all words seen once there; each cost a row of them before."""
    r = np.random.default_rng(7)
    c = 6
    m = r.integers(0, 50, (c, c))
    once, asked = np.full((c + 1) ** 2, -2, np.int32), []
    gains = lm.gains
    monkeypatch.setattr(lm, "gains", lambda a, *more: (asked.append(len(a)), gains(a, *more))[1])
    for _ in range(5):
        sizes = r.choice([1, 1, 1, 2, 5], 300)
        beside, n = r.integers(0, (c + 1) ** 2, sizes.sum()), r.choice([1, 1, 1, 3], sizes.sum())
        got = lm.best_classes(sizes, beside, n, m, once)
        word = np.repeat(np.arange(300), sizes)
        right, left = np.zeros((300, c)), np.zeros((300, c))
        for w, k, x in zip(word, beside, n):
            if k % (c + 1):
                right[w, k % (c + 1) - 1] += x
            if k // (c + 1):
                left[w, k // (c + 1) - 1] += x
        want = np.where(right.any(axis=1) | left.any(axis=1), gains(right, left, np.zeros(300), m).argmax(axis=1), -1)
        single = np.isin(np.arange(300), np.flatnonzero((sizes == 1) & (n[np.cumsum(sizes) - sizes] == 1)))
        assert got.tolist() == want.tolist()
    assert asked[-1] <= (~single).sum() + 3 < 300  # the last words are at known places, but for a few
    assert len(lm.best_classes(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), m, once)) == 0
