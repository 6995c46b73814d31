"""Rules against plain Python on all documents and on wrapped license texts; prefilters; containment; edge rows."""

import random
import re

import pytest

from quillspark.llm import licenses

SF = "/root/testdata/sf0.01"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    """The contract and the rules by plain search: every rule on every text, containment against all kept detections."""
    t = (text or "").translate(UP)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    starts = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    hits = sorted((m.start(), -m.end(), prio, conf, label) for _, label, prio, conf, _, rx in licenses.rules() for m in re.finditer(rx, t, re.ASCII))
    kept = []
    for h in hits:
        if not any(k[0] <= h[0] and k[1] <= h[1] and k[2] <= h[2] for k in kept):
            kept.append(h)
    base = sorted({label for _, label in starts})
    labels = sorted({*base, *(h[4] for h in kept)})
    score = max([h[3] for h in kept] + [0.7 if starts else 0.0])
    place = [i for i, _ in starts]
    return len(words), len(starts), min(place, default=None), max(place, default=None), ",".join(base), ",".join(labels), score


def scanned(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    return [got[i] for i in range(len(texts))]


def matches(rx, r):
    """A text that the expression matches, at random, with line breaks for white space."""
    from re import _parser as parser

    def one(seq):
        out = ""
        for op, av in seq:
            name = str(op)
            if name == "LITERAL":
                out += chr(av)
            elif name == "IN":
                kind, v = r.choice([x for x in av if str(x[0]) != "NEGATE"])
                negated = any(str(x[0]) == "NEGATE" for x in av)
                out += "q" if negated else chr(v) if str(kind) == "LITERAL" else chr(r.randint(*v)) if str(kind) == "RANGE" else {"CATEGORY_SPACE": "\n   ", "CATEGORY_DIGIT": "7", "CATEGORY_WORD": "w"}[str(v)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, sub = av
                for _ in range(r.choice([low, min(high, low + 1)])):
                    out += one(sub)
                    if [str(x[0]) for x in sub] == ["IN"] and str(sub[0][1][0][1]) == "CATEGORY_SPACE":
                        break
            elif name == "SUBPATTERN":
                out += one(av[-1])
            elif name == "BRANCH":
                out += one(r.choice(av[1]))
            elif name in ("ANY", "NOT_LITERAL"):
                out += "q"
            elif name not in ("ASSERT", "ASSERT_NOT", "AT"):
                raise ValueError(name)
        return out

    return one(parser.parse(rx, re.ASCII))


@pytest.fixture(scope="module")
def samples():
    r = random.Random(7)
    return [(rule, text) for rule in licenses.rules() for text in {matches(rule[5], r) for _ in range(6)}]


def test_prefilters_lose_no_match(samples):
    """Whatever a rule matches holds one of its keywords and a gate word once white space is squeezed."""
    gates = licenses.gates()
    seen = set()
    for (name, *_, keywords, rx), text in samples:
        if re.search(rx, text, re.ASCII):
            seen.add(name)
            squeezed = re.sub(r"\s+", " ", text)
            assert any(k in squeezed for k in keywords.split("|")), (name, text)
            assert any(g in squeezed for g in gates), (name, text)
    assert len(seen) == len(licenses.rules()) == len({r[0] for r in licenses.rules()}) > 300


def test_all_documents_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(docs).collect()}
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 0


def test_every_rule_and_mixtures_of_them(spark, samples):
    r = random.Random(3)
    texts = [t.upper() if r.random() < 0.2 else t for _, t in samples]
    texts += ["\n".join(r.choice(samples)[1] for _ in range(6)) + " The MIT License, the Apache\nlicense and the general public license." for _ in range(150)]
    assert scanned(spark, texts) == [brute(t) for t in texts]


def test_containment_against_every_kept_detection(spark, monkeypatch):
    """A weak hit inside a strong kept one goes, although a longer weak one was kept between them."""
    rules = [("a", "strong", 0, 0.9, "licen", "licen [a-z ]*y"), ("b", "long", 3, 0.5, "licen", "en [a-z ]*z"), ("c", "weak", 2, 0.4, "licen", "in"), ("d", "own", 2, 0.3, "licen", "z")]
    monkeypatch.setattr(licenses, "rules", lambda: rules)
    texts = ["licen a in b y c z", "licen x", "in licen z"]
    got = scanned(spark, texts)
    assert [g[5] for g in got] == ["long,own,strong", "", "long,own,weak"]
    assert got == [brute(t) for t in texts]


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "MIT License", "c"), (3, "MIT License", "d"), (None, "mit-license", "e"), (4, "word " * 50_000 + "apache license", "f"), (5, "mit licensé, mit ﬁ license", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, LABELS string")
    got = licenses.scan(docs).collect()
    assert [(r.doc_id, tuple(r)[1:]) for r in got] == [(d, brute(t)) for d, t, _ in rows]
    assert licenses.scan(docs.limit(0)).count() == 0
