"""Ids against the public library: every kind of text, matches of any length, ranks out of order; exact round trips."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from quillspark.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.TextEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 400_000)


def check(own, library, texts):
    assert [x.split() for x in own.texts(texts)] == [[b"%d" % i for i in library.encode_ordinary(t)] for t in texts]


def test_matches_of_any_length(own, library):
    r = random.Random(4)
    letters, cjk, mixed = "etaoinshrdlu", "的一是不了人我在有他这中大来上国", "aé漢\U0001f600"
    texts = ["a" * n for n in (1, 2, 3, 95, 96, 97, 98, 255, 1000, 30_001)]
    texts += ["".join(r.choice(s) for _ in range(n)) for s in (letters, cjk, mixed, "ab", "the") for n in (40, 97, 130, 600, 3000)]
    texts += ["".join(r.choice(letters) for _ in range(12_000)), "=" * 5000 + "-" * 5001, "\n" * 999 + " " * 777]
    check(own, library, texts)


def test_hostile_texts(own, library):
    r = random.Random(9)
    chars = [chr(c) for c in (*range(0x20, 0x250), *range(0x370, 0x400), 0x600, 0x915, 0x4E00, 0x1F600, 0x200B, 0x85, 0xA0, 0x2028, 0xFFFD, 0x7F, 0x1, 9, 10, 13)]
    check(own, library, ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(2000)])
    check(own, library, [chr(c) for c in (*range(0, 0xD800, 7), *range(0xE000, 0x11000, 13))])


def test_a_token_that_ranks_after_a_pair_with_it(tmp_path):
    """Ranks in an order that no training gives: only the leftmost place may be merged in a round."""
    r = random.Random(1)
    for _ in range(40):
        tokens = {bytes([i]) for i in range(256)}
        while len(tokens) < 256 + 25:
            a, b = (r.choice([t for t in tokens if set(t) <= set(b"ab")]) for _ in "12")
            if len(a + b) < 7:
                tokens.add(a + b)
        long = [t for t in tokens if len(t) > 1]
        r.shuffle(long)
        ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(long)}
        path = tmp_path / "ranks"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()))
        own, lib = bpe.ByteBpe(str(path), P.PATTERN), tiktoken.Encoding("t", pat_str="[ab]+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 60))) for _ in range(60)]
        assert own.encode_pieces([w.encode() for w in words]) == [lib.encode_ordinary(w) for w in words]


def test_query_and_round_trip(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    encoded = bpe.ids(docs)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {d: library.encode_ordinary(t) for d, t in text.items()}
    assert {r.doc_id: bytes(r.content).decode() for r in bpe.decode(encoded).collect()} == text


def test_edge_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    rows = [(1, None, "a"), (1, "", "b"), (None, "x", "c"), (2, "é\U0001f600", "d"), (2, "é\U0001f600", "e"), (3, "word " * 50_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    got = bpe.encode(docs).collect()
    assert [(r.doc_id, r.n_tokens > 0) for r in got] == [(1, False), (1, False), (None, True), (2, True), (2, True), (3, True)]
    assert [r.ids_sha256 == empty for r in got] == [True, True, False, False, False, False] and got[3] == got[4]
    assert all(r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t, _) in zip(got, rows))
    assert bpe.encode(docs.limit(0)).count() == 0 and bpe.decode(bpe.ids(docs.limit(0))).count() == 0
