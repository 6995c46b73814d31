"""Ids against the public library, sequences against their capacity and a lower bound, the fit against plain search."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(library, rows, cap=4096):
    """doc_id -> its pieces (piece, start, length, crc) by the library on the whole text."""
    out = defaultdict(list)
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), cap)):
            part = ids[s : s + cap]
            out[d].append((k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check(got, want, cap=4096):
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {d: sorted(v) for d, v in have.items()} == {d: sorted(v) for d, v in want.items()}
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= cap
    return len(seqs)


def test_all_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected(library, [(r.doc_id, r.text) for r in docs.collect()])
    total = sum(p[2] for v in want.values() for p in v)
    assert check(packing.pack(docs).collect(), want) <= math.ceil(total / 4096) + 2


def test_hostile_texts(spark, library):
    r = random.Random(8)
    chars = "abcXYZ 019.,;:!?'\"()-_<|>\t\nßéÉñçŠжЖ漢字\U0001f600  ́©"
    rows = [(i, "".join(r.choice(chars) for _ in range(r.randrange(80)))) for i in range(1500)]
    rows += [(1500, "<|endoftext|> word <|x|>"), (1501, "Word, 7. (END)"), (1502, "don't " * 900 + "x" * 3000)]
    check(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), expected(library, rows))


def fewest(lengths, cap):
    """The fewest sequences, by trying all ways."""
    best = len(lengths)

    def go(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in {f: k for k, f in enumerate(free) if f >= lengths[i]}.values():
            go(i + 1, free[:k] + [free[k] - lengths[i]] + free[k + 1 :])
        go(i + 1, free + [cap - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_plan_against_all_ways():
    r = random.Random(2)
    extra = 0
    for _ in range(60):
        lengths = [r.randrange(1, 41) for _ in range(r.randrange(1, 11))]
        runs, seqs = packing.plan(dict(Counter(lengths)), 40, 8)
        load, place = Counter(), defaultdict(list)
        for n, first, count, seq, offset in runs:
            for i in range(count):
                load[seq + i] += n
                place[n].append(first + i)
        assert all(sorted(place[n]) == list(range(c)) for n, c in Counter(lengths).items()) and max(load.values()) <= 40
        extra += seqs - fewest(lengths, 40)
    assert extra <= 6  # in 60 plans together


def test_nnls_against_all_supports():
    r = np.random.default_rng(1)
    for _ in range(30):
        a, b = r.random((6, 4)), r.random(6)
        best = np.inf
        for k in range(5):
            for on in map(list, itertools.combinations(range(4), k)):
                z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
                if (z >= 0).all():
                    best = min(best, np.linalg.norm(a[:, on] @ z - b))
        x = packing.nnls(a, b)
        assert (x >= 0).all() and abs(np.linalg.norm(a @ x - b) - best) < 1e-8


def test_patterns_decide_the_fill(spark):
    """Documents of three lengths that fill a sequence only together."""
    sizes = [2016, 1504, 576]  # whole units of the grid
    rows = [(i, "the " * (sizes[i % 3] - 1)) for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.sequence_id for r in got}) == 100


def test_edge_rows(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x", "c"), (3, "x", "d"), (None, "x y", "e"), (4, "word " * 50_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, LENGTH string")
    check(packing.pack(docs).collect(), expected(library, [r[:2] for r in rows]))
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.fixture()
def encoder():
    return packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 300_000)


def test_known_words_with_closing_marks_are_not_encoded_again(encoder):
    """the library gets the marks alone, once; each new word behind a known stem cost one more call of it."""
    asked = []
    learn = encoder.learn
    encoder.learn = lambda new: (asked.extend(new), learn(new))
    encoder.encode([b"word other"])
    encoder.encode([b"word### other$$$ word,%%% other&&& word*** word) other]\" word'"])
    assert sorted(asked) == sorted([b"word", b"other", b"###", b"$$$", b",%%%", b"&&&", b"***", b")", b']"', b"'"])


def test_closing_marks_against_the_library(encoder, library):
    r = random.Random(3)
    marks = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
    ends = [*marks, *(a + b for a in marks for b in marks), "<|endoftext|>", "<|endoftext|>.", "|>.", "'s", "'s.", "'ll'", ".'t", "̸", "≠", " .", " "]
    stems = ["word", "Word", "café", "жж", "x7", "7", "", "漢", "don't", "a-b", "<|endoftext", "<|endoftext|>n", "é"]
    texts = [" ".join(r.choice(stems) + r.choice(ends) for _ in range(6)) for _ in range(3000)]
    texts += [s + e for s in stems for e in ends]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode([t.encode() for t in texts]) == want


def test_ids_stay_the_same_as_caches_fill(library):
    """Small caches, so that words go to the old one, come back and are forgotten, with a table of frequent words beside."""
    r = random.Random(4)
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 300)
    often = 0
    for turn in range(30):
        texts = [" ".join(f"w{chr(97 + int(r.expovariate(0.2)) % 26)}{chr(97 + r.randrange(26)) * r.randrange(3)}{r.choice(['', '.', '##'])}" for _ in range(3000)) for _ in range(30 if turn % 3 else 1)]
        got = enc.encode([t.encode() for t in texts])
        often += bool(enc.hot)
        assert set(enc.hot) <= set(enc.cache)
        i = r.randrange(len(texts))
        assert got[i] == np.array(library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
    assert often and enc.old
