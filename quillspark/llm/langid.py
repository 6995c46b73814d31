"""Operator 9: language identification by multilingual mixture inference.

Training counts hashed character n-grams of words for each language over all training documents (a table of fixed size
for each language). A word's likelihood under a language is that of its n-grams. For each document EM estimates the
proportions of languages that explain its words; languages enter the set one by one, in order of proportion, as long as
the penalised likelihood (BIC) grows. The prediction is the language with the largest proportion in the chosen set, and
the score is its proportion.

A word is a run of letters (Unicode category L). The model is gathered and broadcast: ``buckets`` numbers for each of at
most ``max_langs`` languages; more languages than that are an error.

Edge cases: null text and text without a letter are ``und`` with score 0; null labels don't train; without any training
row everything is ``und``; very long texts are used whole; ties go to the alphabetically first language; repeated rows
are predicted alike; an empty table gives an empty result; extra columns, also with clashing names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, pick, slices


def _splitter():
    """Splits at all that is no letter: what the library counts as a word character but not as a letter is numbers."""
    import re
    import sys

    code = np.array([c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha()])
    cut = np.flatnonzero(np.diff(code) > 1)
    numbers = "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(code[np.append(0, cut + 1)], code[np.append(cut, len(code) - 1)]))
    return re.compile(rf"[\W_{numbers}]+").split


@dataclass(frozen=True)
class LangParams:
    folds: int = 5
    held_fold: int = 0
    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)  # up to 3: the shortest word with its marks has three places
    rounds: int = 12
    penalty: float = 3.0  # of each further language, times log(words) / 2
    smooth: float = 0.5
    cache: int = 300_000
    reject_below: float = 0.5
    max_langs: int = 512


def _grams(words: list[str], orders, mask) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: buckets of the n-grams of ^word$, the word of each, and where each word's begin."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    out = []
    for n in orders:
        last = len(code) - n + 1
        h = np.full(last, 1469598103934665603 + n, np.uint64)
        for k in range(n):
            h = (h ^ code[k : last + k]) * np.uint64(1099511628211)
        within = word[:last] == word[n - 1 :]
        h = ((h ^ (h >> np.uint64(31))) & np.uint64(mask)).astype(np.int64)[within]
        per_word = np.maximum(lengths - n + 1, 0)
        out.append((h, word[:last][within], np.cumsum(per_word) - per_word))
    return out


def train(docs: DataFrame, p: LangParams) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of buckets) from all rows with text and lang. Size: languages x buckets."""
    mask, orders, buckets = p.buckets - 1, p.orders, p.buckets

    def run(batches):
        split, counts = _splitter(), {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = [w for w in split(text.lower()) if w]
                if not words:
                    continue
                v = counts.setdefault(lang, {})
                for w in words:
                    v[w] = v.get(w, 0) + 1
            if sum(map(len, counts.values())) > 200_000:
                yield from flush(counts)
                counts = {}
        yield from flush(counts)

    def flush(counts):
        for lang, v in counts.items():
            n = np.fromiter(v.values(), np.int64, len(v))
            sums = np.zeros(buckets, np.int64)
            for bucket, word, _ in _grams(list(v), orders, mask):
                sums += np.bincount(bucket, n[word], buckets).astype(np.int64)
            idx = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(idx), pa.string()), pa.array(idx, pa.int64()), pa.array(sums[idx], pa.int64())], names=["lang", "bucket", "n"])

    rows = pick(docs, "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    got = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table: dict[str, np.ndarray] = {}
    for r in got.toLocalIterator():  # at most buckets rows for each language
        table.setdefault(r[0], np.zeros(buckets))[r[1]] = r[2]
        if len(table) > p.max_langs:
            raise ValueError(f"more than {p.max_langs} languages; max_langs bounds the model")
    langs = sorted(table)
    logp = np.array([np.log((table[x] + p.smooth) / (table[x].sum() + p.smooth * buckets)) for x in langs]).reshape(len(langs), buckets)
    return langs, logp


def _em(like: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document. like: words x languages, scaled to a row maximum of 1."""
    n = np.diff(np.append(starts, len(like)))
    theta = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        post = like * np.repeat(theta, n, axis=0)
        post /= post.sum(axis=1, keepdims=True)
        theta = np.add.reduceat(post, starts, axis=0) / n[:, None]
    mix = (like * np.repeat(theta, n, axis=0)).sum(axis=1)
    return theta, np.add.reduceat(np.log(np.maximum(mix, 1e-300)), starts)


def mixture(like: np.ndarray, starts: np.ndarray, p: LangParams) -> tuple[np.ndarray, np.ndarray]:
    """Chosen proportions of each document (0 outside its set) and the number of languages in the set."""
    docs, langs = len(starts), like.shape[1]
    n = np.diff(np.append(starts, len(like)))
    full, _ = _em(like, starts, np.ones((docs, langs)), p.rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    alone = np.add.reduceat(np.log(np.maximum(like, 1e-12)), starts, axis=0)
    first = alone.argmax(axis=1)
    best = np.zeros((docs, langs))
    best[np.arange(docs), first] = 1
    score, size = alone[np.arange(docs), first], np.ones(docs, int)
    open_ = np.arange(docs)
    for k in range(2, langs + 1):
        # a further language must have a share in the full mixture to be worth a fit
        open_ = open_[full[open_, order[open_, k - 1]] > 0.02]
        if not len(open_):
            break
        rows = np.concatenate([np.arange(starts[d], starts[d] + n[d]) for d in open_])
        allowed = np.zeros((len(open_), langs))
        np.put_along_axis(allowed, order[open_, :k], 1, axis=1)
        theta, ll = _em(like[rows], np.concatenate([[0], np.cumsum(n[open_])[:-1]]), allowed, p.rounds)
        cost = p.penalty * 0.5 * np.log(n[open_] + 1)
        better = ll - (k - 1) * cost > score[open_]
        win = open_[better]
        best[win], score[win], size[win] = theta[better], (ll - (k - 1) * cost)[better], k
        open_ = win
    return best, size


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], p: LangParams, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, lang_pred, score, n_langs for every row of docs (columns carry and text)."""
    langs, logp = model
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T.astype(np.float32)))  # buckets x languages
    need = tuple(dict.fromkeys((*carry, "text")))
    at_text, mask, orders, most = need.index("text"), p.buckets - 1, p.orders, p.cache
    rows = pick(docs, *need)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema) + ", lang_pred string, score double, n_langs int"

    def run(batches):
        split, table, memo = _splitter(), sent.value, {}
        vectors = np.zeros((most + 200_000, len(langs)), np.float32)
        for b in batches:
            preds, scores, sizes = [], [], []
            for part in slices(b, at_text, 500, 1 << 20):
                texts = part.column(at_text).to_pylist()
                found = [[w for w in split(t.lower()) if w] if t and langs else [] for t in texts]
                pred, score, size = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
                here = [i for i, f in enumerate(found) if f]
                if here:
                    if len(memo) > most:
                        memo.clear()
                    new = list({w for i in here for w in found[i] if w not in memo})
                    if new:
                        lp = sum(np.add.reduceat(table[bucket], first, axis=0) for bucket, _, first in _grams(new, orders, mask))
                        base = len(memo)
                        if base + len(new) > len(vectors):
                            vectors = np.concatenate([vectors, np.zeros((base + 2 * len(new), len(langs)), np.float32)])
                        vectors[base : base + len(new)] = np.exp(lp - lp.max(axis=1, keepdims=True))
                        memo.update(zip(new, range(base, base + len(new))))
                    get = memo.__getitem__
                    ids = np.array([j for i in here for j in map(get, found[i])])
                    like = np.maximum(vectors[ids].astype(np.float64), 1e-6)
                    counts = [len(found[i]) for i in here]
                    theta, k = mixture(like, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), p)
                    top = theta.argmax(axis=1)
                    for i, t, s, z in zip(here, top, theta[np.arange(len(top)), top], k):
                        pred[i], score[i], size[i] = langs[t], float(min(1.0, s)), int(z)
                preds += pred
                scores += score
                sizes += size
            cols = [b.column(need.index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())], names=[*carry, "lang_pred", "score", "n_langs"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, p: LangParams | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; rows of the held-out fold don't train."""
    p = p or LangParams()
    rows = pick(docs, "doc_id", "text", "lang")
    held = crc_bucket(F.col("doc_id"), p.folds) == p.held_fold
    model = train(rows.where(~held), p)
    return predict(rows, model, p).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, columns: tuple[str, ...], p: LangParams | None = None) -> DataFrame:
    """Rows with a language (not und) whose largest proportion reaches reject_below, with ``columns``."""
    p = p or LangParams()
    held = crc_bucket(F.col("doc_id"), p.folds) == p.held_fold
    model = train(pick(docs, "doc_id", "text", "lang").where(~held), p)
    return predict(docs, model, p, carry=columns).where((F.col("lang_pred") != "und") & (F.col("score") >= p.reject_below)).select(*columns)
