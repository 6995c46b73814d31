"""Operator 8: byte-level BPE encoding and decoding with numpy matrices.

A text is split by the pattern. Distinct matches that a worker doesn't remember are put into padded matrices by length,
whatever their length; each round every row looks up the ranks of its adjacent pairs in a hash table, merges its leftmost
pair of minimum rank and is compacted; rows without a pair leave. In the same round a row also merges the further places
of that pair, from left to right: the next rounds would, as a pair with the new token ranks higher than the token. Where
the ranks say otherwise for a token, only the leftmost place is merged. The public pattern is matched by the standard
library, with its classes written out as ranges, in texts without characters beyond the basic plane; others, and other
patterns, take the regex library.

Edge cases: null text counts as empty (no ids); any Unicode text is encoded, so decoding gives its bytes back; ties
between places of equal rank go to the left; very long texts and matches are encoded whole; repeated rows are encoded
alike; an empty table gives an empty result; extra columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices

#: Widths of the matrices in bytes; beyond them each is twice the one before.
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96)
WIDTH = [BUCKETS[bisect_left(BUCKETS, n)] for n in range(BUCKETS[-1] + 1)]
CELLS = 800_000  # of a matrix, unless one row has more


@dataclass(frozen=True)
class BpeParams:
    ranks: str = ""  # path of the rank file; empty: the public byte BPE
    pattern: str = ""  # empty: the public pattern
    cache: int = 400_000  # matches whose ids a worker remembers


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.rank.items()}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        top = max(self.rank.values()) + 1
        self.none = np.int64(top)
        # every way to cut a token into two tokens is a pair that merges to it
        keys, vals = [], []
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a * top + b)
                    vals.append(r)
        self.top = top
        # tokens in a pair that ranks before them
        self.late = np.zeros(top + 1, bool)
        for k, r in zip(keys, vals):
            for part in divmod(k, top):
                self.late[part] |= part > r
        size = 1 << (2 * len(keys)).bit_length()
        self.mask = size - 1
        self.keys, self.vals = np.full(size, -1, np.int64), np.full(size, top, np.int64)
        todo, v = np.array(keys, np.int64), np.array(vals, np.int64)
        at = self._hash(todo)
        while len(todo):  # open addressing, filled in rounds
            empty = self.keys[at] < 0
            _, first = np.unique(np.where(empty, at, -1 - np.arange(len(at))), return_index=True)
            win = np.zeros(len(at), bool)
            win[first] = True
            win &= empty
            self.keys[at[win]], self.vals[at[win]] = todo[win], v[win]
            todo, v, at = todo[~win], v[~win], (at[~win] + 1) & self.mask

    def _hash(self, k):
        h = k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) & np.uint64(self.mask)).astype(np.int64)

    def pairs(self, a, b):
        """Rank of each pair, top where it doesn't merge; a or b of -1 is padding."""
        key = np.where((a < 0) | (b < 0), np.int64(-2), a * self.top + b)
        at = self._hash(key)
        out = np.full(key.shape, self.none)
        todo = np.flatnonzero(key >= 0)
        flat, kf, of = at.ravel(), key.ravel(), out.ravel()
        while len(todo):
            got = self.keys[flat[todo]]
            hit = got == kf[todo]
            of[todo[hit]] = self.vals[flat[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
            flat[todo] = (flat[todo] + 1) & self.mask
        return of.reshape(key.shape)

    def matrix(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of similar length."""
        n, width = len(pieces), max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        m = np.where(np.arange(width) < lengths[:, None], self.byte[raw], -1)
        done: list = [None] * n
        rows = np.arange(n)
        ranks = self.pairs(m[:, :-1], m[:, 1:]) if width > 1 else np.empty((n, 0), np.int64)
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), self.none)
            live = low < self.none
            if not live.all():
                for r, ids in zip(rows[~live].tolist(), m[~live].tolist()):
                    done[r] = [x for x in ids if x >= 0]
                rows, m, best, low, ranks = rows[live], m[live], best[live], low[live], ranks[live]
                if not len(rows):
                    break
            if m.shape[1] > BUCKETS[0]:
                hit = (ranks == low[:, None]) & ~self.late[low][:, None]
                if (hit.sum(axis=1) > 1).any():
                    m, ranks = self._merge_all(m, ranks, hit, best, low)
                    continue
            # the merged token takes the place of the first of its pair; what follows moves up by one
            every, after = np.arange(len(rows)), np.arange(m.shape[1] - 1) > best[:, None]
            m = np.where(after, m[:, 1:], m[:, :-1])
            m[every, best] = low
            ranks = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            # only the pairs on both sides of the merged token are new
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < ranks.shape[1])
            at = np.concatenate([left, right])
            first = np.concatenate([best[left] - 1, best[right]])
            ranks[at, first] = self.pairs(m[at, first], m[at, first + 1])
            while m.shape[1] > 1 and (m[:, -1] < 0).all():
                m, ranks = m[:, :-1], ranks[:, :-1]
        return done

    def _merge_all(self, m, ranks, hit, best, low):
        """One round in which each row merges every place in hit that overlaps no merged one to its left."""
        every, at = np.arange(len(m)), np.arange(ranks.shape[1])
        hit[every, best] = True  # the leftmost place always
        begins = hit.copy()
        begins[:, 1:] &= ~hit[:, :-1]
        hit &= (at - np.maximum.accumulate(np.where(begins, at, 0), axis=1)) % 2 == 0  # every other one of a run
        merged = np.zeros(m.shape, bool)
        merged[:, :-1] = hit
        stays = m >= 0
        stays[:, 1:] &= ~hit
        size = stays.sum(axis=1)
        place = np.arange(size.max()) < size[:, None]

        def compact(x, fill):
            out = np.full(place.shape, fill, x.dtype)
            out[place] = x[stays]
            return out

        m = compact(np.where(merged, low[:, None], m), -1)
        ranks = compact(np.append(ranks, np.full((len(ranks), 1), self.none), axis=1), self.none)[:, :-1]
        new = compact(merged, False)
        row, col = np.nonzero(new[:, :-1] | new[:, 1:])
        ranks[row, col] = self.pairs(m[row, col], m[row, col + 1])
        return m, ranks

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, x in enumerate(pieces):
            if x in self.rank:
                out[i] = [self.rank[x]]
            else:
                groups.setdefault(WIDTH[len(x)] if len(x) < len(WIDTH) else 1 << len(x).bit_length(), []).append(i)
        for w, idx in groups.items():
            step = min(8192, max(1, CELLS // w))
            for at in range(0, len(idx), step):
                part = idx[at : at + step]
                for i, ids in zip(part, self.matrix([pieces[i] for i in part])):
                    out[i] = ids
        return out


def _bpe(p: BpeParams) -> tuple[str, str]:
    import public_tokenizers

    return p.ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), p.pattern or public_tokenizers.PATTERN


def _ranges(kind: str) -> str:
    """The characters of the basic plane that match, as ranges for a class of the standard library."""
    import regex

    code = np.array([ord(c) for c in regex.findall(kind, "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000)))))])
    cut = np.flatnonzero(np.diff(code) > 1)
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(code[np.append(0, cut + 1)], code[np.append(cut, len(code) - 1)]))


def splitter(pattern: str):
    """A function that gives the matches of the pattern in a text."""
    import public_tokenizers
    import regex

    general = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return general
    letter, number, space = map(_ranges, (r"\p{L}", r"\p{N}", r"\s"))
    # the public pattern; a contraction begins with what letters and numbers don't, so it can come after them
    plain = re.compile(rf" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    return lambda text: plain(text) if text.isascii() or max(text) <= "\uffff" else general(text)


class TextEncoder:
    """Tokens of whole texts by way of their matches; remembers up to ``most`` matches and a batch more."""

    def __init__(self, path: str, pattern: str, most: int):
        self.bpe, self.most, self.split = ByteBpe(path, pattern), most, splitter(pattern)
        self.word = {i: b"%d" % i for i in self.bpe.token}
        self.ids: dict[str, bytes] = {}  # match -> its ids as text
        self.back: dict[str, bytes] = {}  # match -> what its ids decode to

    def learn(self, new: list[str]) -> None:
        word, token = self.word.__getitem__, self.bpe.token.__getitem__
        for x, got in zip(new, self.bpe.encode_pieces([x.encode("utf-8", "surrogatepass") for x in new])):
            self.ids[x], self.back[x] = b" ".join(map(word, got)), b"".join(map(token, got))

    def _split(self, texts: list[str | None]) -> list[list[str]]:
        """The matches of each text; afterwards the ids of all are known."""
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.ids) > self.most:
            self.ids.clear()
            self.back.clear()
        self.learn(list(set().union(*parts).difference(self.ids)))
        return parts

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, joined by spaces."""
        ids = self.ids.__getitem__
        return [b" ".join(map(ids, xs)) for xs in self._split(texts)]

    def digests(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """For each text: number of ids, sha256 of the ids as text, sha256 of the decoded bytes."""
        parts = self._split(texts)
        ids, back = self.ids.__getitem__, self.back.__getitem__
        out: tuple[list, list, list] = ([], [], [])
        for xs in parts:
            text = b" ".join(map(ids, xs))
            for o, v in zip(out, (text.count(b" ") + 1 if xs else 0, hashlib.sha256(text).hexdigest(), hashlib.sha256(b"".join(map(back, xs))).hexdigest())):
                o.append(v)
        return out


@functools.lru_cache(1)
def encoder(path: str, pattern: str, most: int) -> TextEncoder:
    """One encoder for the tasks that a Python worker runs one after the other."""
    return TextEncoder(path, pattern, most)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, p: BpeParams | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row. No shuffle."""
    p = p or BpeParams()
    path, pattern, most = *_bpe(p), p.cache

    def run(batches):
        enc = encoder(path, pattern, most)
        for b in batches:
            for part in slices(b, 1, 500):
                n, ids, decoded = enc.digests(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").mapInArrow(run, OUT)


def ids(docs: DataFrame, p: BpeParams | None = None) -> DataFrame:
    """doc_id and the ids themselves, for training."""
    p = p or BpeParams()
    path, pattern, most = *_bpe(p), p.cache

    def run(batches):
        enc = encoder(path, pattern, most)
        for b in batches:
            for part in slices(b, 1, 500):
                rows = [np.array(x.split(), np.int64) for x in enc.texts(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, p: BpeParams | None = None) -> DataFrame:
    """(doc_id, ids) -> doc_id, content: the bytes; null ids count as none."""
    p = p or BpeParams()
    path, pattern, most = *_bpe(p), p.cache

    def run(batches):
        token = encoder(path, pattern, most).bpe.token.__getitem__
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(map(token, x or ())) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")
