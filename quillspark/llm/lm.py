"""Operator 5: scoring by a Brown class-based bigram model.

P(word | previous) = P(class | previous class) * P(word | class). Exchange clustering assigns every training word to a
class: a word goes where the likelihood of the class bigrams grows most. All words of at least a certain count take part
in distributed sweeps: each sweep counts, over all training documents, the classes beside every word, and a word's
counts meet in one task that decides on its class; half of the words move in a sweep, and the classes of the best
likelihood stay. The count is 2, or the least one that at most ``head`` words reach; these words have a number, and a
task holds their classes as one array. The ``seed`` most frequent ones start from an exchange word by word on their
bigrams. The other training words get one exchange step against the final classes, as a table over all of them, joined
to their places in the texts. A word never seen in training has the class that most words seen once with its ending have.

Word counts, class transitions and class sizes are counted over all training documents. What is gathered or broadcast
is bounded by parameters: ``head`` words with count and class, ``seed``^2 bigrams, classes^2 transitions, ``endings``.
Texts are split twice, for the counts and for the numbers; everything else reads the numbers.

Edge cases: null text counts as empty: its one token is the end; a null id counts as empty text in the fold rule; very
long texts are scored whole; ties between classes go to the lowest number; repeated rows are scored alike; without
training documents all words are unknown; an empty table gives an empty result; extra columns, also with clashing names,
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, materialize, pick, release, slices


@dataclass(frozen=True)
class BrownParams:
    folds: int = 7
    held_fold: int = 2
    head: int = 1 << 18  # words with a number
    seed: int = 1000  # words clustered one by one at the start
    classes: int = 64  # at most 254
    rounds: int = 8  # over the seed
    sweeps: int = 2  # distributed, of half of the words each
    buckets: int = 128  # groups of words that sweeps decide on
    dense: int = 4096  # words whose counts a task holds as an array
    endings: int = 1024
    alpha: float = 500.0  # weight of the class frequencies in the transitions
    flush: int = 500_000  # words that a task counts before it sends them on


UNKNOWN = 255


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of binary texts in a row, and where each text's begin and the last one's end; bytes split at
    ASCII white space and lower A-Z alone."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))
    flat, at = lists.flatten().view(pa.binary()), lists.offsets.to_numpy()
    at = at - at[0]
    full = pc.binary_length(flat).to_numpy() > 0  # white space at an edge leaves an empty word
    if not full.all():
        flat, at = flat.filter(pa.array(full)), np.append(0, np.cumsum(full))[at]
    return flat, at


def word_counts(train: DataFrame, flush: int) -> DataFrame:
    """(word, n) over all training texts; the empty word stands for the end of a document."""

    def summed(parts):
        words, counts = (pa.concat_arrays([p[i] for p in parts]) for i in range(2))
        got = pa.table({"word": words, "n": counts}).group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
        return got.column("word").chunk(0), got.column("n_sum").chunk(0)

    def batch(words, counts):
        return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

    def run(batches):
        parts, held, ends = [], 0, 0
        for b in batches:
            ends += b.num_rows
            for part in slices(b, 0, 2000):
                words, _ = _words(part.column(0))
                if not len(words):
                    continue
                got = pc.value_counts(words)
                parts.append((got.field("values"), got.field("counts")))
                held += len(got)
                if held > 2 * flush or sum(p[0].nbytes for p in parts) > 1 << 28:
                    parts = [summed(parts)]
                    held = len(parts[0][0])
                    if held > flush or parts[0][0].nbytes > 1 << 27:
                        yield batch(*parts[0])
                        parts, held = [], 0
        if parts:
            yield batch(*summed(parts))
        if ends:
            yield batch(pa.array([b""], pa.binary()), pa.array([ends], pa.int64()))

    return train.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _sparse(total: np.ndarray):
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["k", "n"])


def _gather(df: DataFrame, size: int) -> np.ndarray:
    """Sums by key, of a table (k, n) with at most size keys."""
    out = np.zeros(size, np.int64)
    got = df.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """Of class bigram counts, up to a constant."""
    m = m.astype(float)
    return float(_f(m).sum() - _f(m.sum(axis=1)).sum() - _f(m.sum(axis=0)).sum())


def exchange(bigrams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each word; word 0 (the end) keeps class 0 alone. Maximises the class bigram likelihood."""
    k = len(bigrams)
    of = np.zeros(k, np.int64)
    of[1:] = 1 + np.arange(k - 1) % (classes - 1)
    one = np.zeros((k, classes))
    one[np.arange(k), of] = 1
    w = bigrams.astype(float)
    right, left = w @ one, w.T @ one  # counts of a word with each class after and before it
    m = one.T @ w @ one
    for _ in range(sweeps):
        moved = 0
        for i in range(1, k):
            old, own = of[i], w[i, i]
            r, le = right[i].copy(), left[i].copy()
            r[old] -= own
            le[old] -= own
            m[old, :] -= r
            m[:, old] -= le
            m[old, old] -= own
            gain = gains(r[None], le[None], np.array([own]), m)[0]
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            m[new, :] += r
            m[:, new] += le
            m[new, new] += own
            if new != old:
                moved += 1
                of[i] = new
                right[:, old] -= w[:, i]
                right[:, new] += w[:, i]
                left[:, old] -= w[i, :]
                left[:, new] += w[i, :]
        if moved < k // 200:
            break
    return of


def gains(r: np.ndarray, le: np.ndarray, own: np.ndarray, m: np.ndarray, old: np.ndarray | None = None) -> np.ndarray:
    """words x classes: likelihood gained by adding a word to a class.

    r, le: counts of each word beside the classes after and before it, without its pairs with itself (own). m: the class
    bigrams, without the words or, with old, with each word in its class old, which it leaves first.
    """
    n, c = r.shape
    m = m.astype(float)
    rows, cols, d = m.sum(axis=1), m.sum(axis=0), np.diag(m)
    out = np.zeros((n, c))
    for x, table in ((r, m.T), (le, m)):  # table[j]: the cells that a count beside class j adds to, for each class
        word, slot = np.nonzero(x)
        for at in range(0, len(word), 50_000):
            i, j = word[at : at + 50_000], slot[at : at + 50_000]
            part = _f(table[j] + x[i, j][:, None]) - _f(table)[j]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            out[i[first]] += np.add.reduceat(part, first, axis=0)
    both = d + r + le + own[:, None]
    out += _f(both) - _f(d + r) - _f(d + le) + _f(d)[None]
    n_out, n_in = (r.sum(axis=1) + own)[:, None], (le.sum(axis=1) + own)[:, None]
    above, below = (rows + le, cols + r) if old is None else (rows, cols)  # what precedes or follows the word stays in its row or column
    out -= _f(above + n_out) - _f(above) + _f(below + n_in) - _f(below)
    if old is not None:
        every = np.arange(n)
        # beside the class that the word leaves
        a, b, ro, lo = m.T[old], m[old], r[every, old][:, None], le[every, old][:, None]
        out += _f(a - le + ro) - _f(a - le) - _f(a + ro) + _f(a)
        out += _f(b - r + lo) - _f(b - r) - _f(b + lo) + _f(b)
        # back to the class that it left
        here = d[old]
        stay = (_f(b) - _f(b - r)).sum(axis=1) + (_f(a) - _f(a - le)).sum(axis=1)
        ro, lo = ro[:, 0], lo[:, 0]
        stay -= _f(here) - _f(here - ro) + _f(here) - _f(here - lo)
        stay += _f(here) - _f(here - ro - lo - own)
        stay -= _f(rows[old]) - _f(rows[old] - n_out[:, 0]) + _f(cols[old]) - _f(cols[old] - n_in[:, 0])
        out[every, old] = stay
    out[:, 0] = -np.inf
    return out


IDS = "uid long, doc_id long, held boolean, ids binary, tail array<binary>"


def numbered(rows: DataFrame, words) -> DataFrame:
    """rows (uid, doc_id, text as binary, held) -> IDS: the numbers of the words, -1 for those in tail, in order."""

    def run(batches):
        number = pa.array(words.value, pa.binary())
        for b in batches:
            for part in slices(b, 2, 8000, 16 << 20):
                flat, at = _words(part.column(2))
                kinds = flat.dictionary_encode()
                k = pc.index_in(kinds.dictionary, value_set=number).fill_null(-1).to_numpy().astype("<i4")[kinds.indices.to_numpy()]
                out = np.append(0, np.cumsum(k < 0))[at].astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(k)])
                tail = pa.ListArray.from_arrays(pa.array(out), flat.filter(pa.array(k < 0)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), ids, tail], names=["uid", "doc_id", "held", "ids", "tail"])

    return rows.mapInArrow(run, IDS)


def _flat(batches, column: int = 0):
    """The numbers of many documents in a row, with the end (0) before, between and behind them."""
    end = np.zeros(1, "<i4").tobytes()
    for b in batches:
        for part in slices(b, column, 1 << 20, 16 << 20):
            yield np.frombuffer(end + end.join(part.column(column).to_pylist()) + end, "<i4")


def _transitions(train: DataFrame, of: np.ndarray, c: int) -> np.ndarray:
    """Class bigrams of neighbours that both have a class; of ends in -1 for words without a number."""
    sent = train.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        total = np.zeros(c * c, np.int64)
        for flat in _flat(batches):
            k = sent.value[flat].astype(np.int64)
            ok = (k[:-1] >= 0) & (k[1:] >= 0)
            total += np.bincount((k[:-1] * c + k[1:])[ok], minlength=c * c)
        yield _sparse(total)

    return _gather(train.select("ids").mapInArrow(run, "k long, n long"), c * c).reshape(c, c)


def _packed(x: np.ndarray) -> bytes:
    """uint32 values, byte by byte place, compressed."""
    return pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(x, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4")[:, 0].astype(np.int64)


def _sweep(train: DataFrame, of: np.ndarray, moving: np.ndarray, p: BrownParams) -> np.ndarray:
    """of after every word in moving went to the class of the highest gain; words with class -1 get their first one."""
    c, b, width = p.classes, p.buckets, 2 * p.classes + 1
    m = _transitions(train, of, c)
    size = len(of) - 1
    dense = min(p.dense, size)
    sent = train.sparkSession.sparkContext.broadcast((of, np.append(moving, False), m))

    def count(batches):
        """Counts of words beside classes as (bucket, entries, keys, n), keys as differences in order."""
        of, moving, _ = sent.value
        top, rest, held = np.zeros(dense * width, np.int64), [], 0

        def flush():
            keys = np.flatnonzero(top)
            ns = top[keys]
            if rest:
                k, n = np.unique(np.concatenate(rest), return_counts=True)
                keys, ns = np.append(keys, k), np.append(ns, n)
            word, slot = keys // width, keys % width
            bucket, key = word % b, word // b * width + slot
            order = np.lexsort((key, bucket))
            bucket, key, ns = bucket[order], key[order], ns[order]
            cut = np.searchsorted(bucket, np.arange(b + 1))
            rows = [(i, x, y) for i, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if x < y]
            top[:] = 0
            rest.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([y - x for _, x, y in rows], pa.int64()),
                pa.array([_packed(np.diff(key[x:y], prepend=0)) for _, x, y in rows], pa.binary()), pa.array([_packed(ns[x:y]) for _, x, y in rows], pa.binary())], names=["bucket", "entries", "keys", "n"])

        for flat in _flat(batches):
            x, y = flat[:-1], flat[1:]
            k = of[flat].astype(np.int64)
            for word, slot, ok in ((x, k[1:], moving[x] & (k[1:] >= 0)), (y, c + k[:-1], moving[y] & (k[:-1] >= 0)), (x, np.full(len(x), 2 * c), moving[x] & (x == y))):
                key = word[ok].astype(np.int64) * width + slot[ok]
                low = key < dense * width
                top += np.bincount(key[low], minlength=dense * width)
                rest.append(key[~low])
                held += len(rest[-1])
            if held > 6_000_000:
                yield flush()
                held = 0
        yield flush()

    def decide(batches):
        """(word, class) of the words whose counts changed it, from all counts of their buckets."""
        of, _, m = sent.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, entries, keys, n in zip(*(col.to_pylist() for col in batch.columns)):
                if bucket not in sums:
                    sums[bucket] = np.zeros((size - bucket + b - 1) // b * width, np.int64)
                sums[bucket][np.cumsum(_unpacked(keys, entries))] += _unpacked(n, entries)
        for bucket, flat in sums.items():
            x = flat.reshape(-1, width).astype(float)
            here = np.flatnonzero(x.any(axis=1))
            x, word = x[here], here * b + bucket
            r, le, own, old = x[:, :c], x[:, c : 2 * c], x[:, 2 * c], of[word].astype(np.int64)
            new = old.copy()
            for some, at in ((old < 0, None), (old >= 0, old)):
                i = np.flatnonzero(some)
                if not len(i):
                    continue
                rr, ll, oo = r[i], le[i], own[i]
                if at is not None:  # pairs with itself were counted beside its own class, too
                    rr[np.arange(len(i)), old[i]] -= oo
                    ll[np.arange(len(i)), old[i]] -= oo
                g = gains(rr, ll, oo, m, None if at is None else old[i])
                best = g.argmax(axis=1)
                better = np.ones(len(i), bool) if at is None else g[np.arange(len(i)), best] > g[np.arange(len(i)), old[i]] + 1e-9
                new[i[better]] = best[better]
            changed = np.flatnonzero(new != old)
            yield pa.RecordBatch.from_arrays([pa.array(word[changed], pa.int64()), pa.array(new[changed], pa.int64())], names=["word", "cls"])

    counts = train.select("ids").mapInArrow(count, "bucket int, entries long, keys binary, n binary")
    got = counts.repartition("bucket").mapInArrow(decide, "word long, cls long").toArrow()  # at most head rows
    out = of.copy()
    out[got.column("word").to_numpy()] = got.column("cls").to_numpy()
    return out


def cluster(train: DataFrame, counts: np.ndarray, p: BrownParams) -> np.ndarray:
    """Classes of the numbered words, and -1 at the end for all others."""
    size, k = len(counts), min(p.seed, len(counts))

    def pairs(batches):
        total = np.zeros(k * k, np.int64)
        for flat in _flat(batches):
            x, y = flat[:-1].astype(np.int64), flat[1:].astype(np.int64)
            ok = (x >= 0) & (x < k) & (y >= 0) & (y < k)
            total += np.bincount(x[ok] * k + y[ok], minlength=k * k)
        yield _sparse(total)

    of = np.full(size + 1, -1, np.int16)
    of[:k] = exchange(_gather(train.select("ids").mapInArrow(pairs, "k long, n long"), k * k).reshape(k, k), p.classes, p.rounds)
    word = np.arange(size)
    if size > k:
        of = _sweep(train, of, word >= k, p)
        rest = np.flatnonzero(of[:-1] < 0)  # no neighbour among the first words: the next sweep knows more
        if len(rest):
            of = _sweep(train, of, of[:-1] < 0, p)
            of[:-1][of[:-1] < 0] = 1
    best, top = of, likelihood(_transitions(train, of, p.classes)) if p.sweeps else 0.0
    for s in range(p.sweeps):
        of = _sweep(train, of, (word > 0) & (word % 2 == s % 2), p)
        now = likelihood(_transitions(train, of, p.classes))
        if now <= top:
            of = best
        best, top = of, max(now, top)
    return best


def best_classes(sizes: np.ndarray, beside: np.ndarray, n: np.ndarray, m: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Class of the highest gain for words without one; -1 without a neighbour that has a class.

    sizes: how many of the places in beside a word has, n: how often. A place is (class before + 1) * (classes + 1) +
    class after + 1. once keeps the answers for words seen once, by their place, and -2 where there is none yet.
    """
    c = len(m)
    start = np.cumsum(sizes) - sizes
    single = (sizes == 1) & (n[start] == 1)
    own = beside[start]  # of words seen once: their place
    asked = ~single
    new, first = np.unique(own[single], return_index=True)
    asked[np.flatnonzero(single)[first[once[new] == -2]]] = True  # one word stands for all
    word = np.repeat(np.cumsum(asked) - 1, sizes)
    here = np.repeat(asked, sizes)
    r, le = np.zeros((int(asked.sum()), c)), np.zeros((int(asked.sum()), c))
    for x, k in ((r, beside % (c + 1) - 1), (le, beside // (c + 1) - 1)):
        ok = here & (k >= 0)
        np.add.at(x, (word[ok], k[ok]), n[ok])
    out = np.full(len(sizes), -1, np.int32)
    out[asked] = np.where(r.any(axis=1) | le.any(axis=1), gains(r, le, np.zeros(len(r)), m).argmax(axis=1), -1)
    once[own[asked & single]] = out[asked & single]
    out[single] = once[own[single]]
    return out


def tail_words(ids: DataFrame, of: np.ndarray, m: np.ndarray, p: BrownParams) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(places, words, endings). places: uid, k (the k-th such word of the text), word, e. words: word, n, cls of all
    training words without a number. endings: class of unseen words for each slot e."""
    c = p.classes
    sent = ids.sparkSession.sparkContext.broadcast((of, m))
    end = np.zeros(1, "<i4").tobytes()

    def run(batches):
        of, _ = sent.value
        for b in batches:
            for part in slices(b, 2, 1 << 20, 16 << 20):
                tail = part.column(3)
                size = np.diff(tail.offsets.to_numpy())
                flat = np.frombuffer(end + end.join(part.column(2).to_pylist()) + end, "<i4")  # as _flat has them
                at, cls = np.flatnonzero(flat < 0), of[flat].astype(np.int64)
                uid, held = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), size) for i in range(2))
                k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
                beside = (cls[at - 1] + 1) * (c + 1) + cls[at + 1] + 1
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(k.astype(np.int32)), tail.flatten(), pa.array(beside.astype(np.int32)), pa.array(held)], names=["uid", "k", "word", "beside", "held"])

    def choose(batches):
        _, m = sent.value
        once = np.full((c + 1) ** 2, -2, np.int32)
        for b in batches:
            for part in (b.slice(at, 2000) for at in range(0, b.num_rows, 2000)):
                got = part.column(2).flatten()
                cls = best_classes(np.diff(part.column(2).offsets.to_numpy()), got.field("beside").to_numpy().astype(np.int64), got.field("n").to_numpy(), m, once)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cls, pa.int32(), mask=cls < 0)], names=["word", "n", "cls"])

    places = materialize(ids.select("uid", "held", "ids", "tail").mapInArrow(run, "uid long, k int, word binary, beside int, held boolean"), "lm-places")
    beside = places.where("NOT held").groupBy("word", "beside").agg(F.count(F.lit(1)).alias("n"))
    per = beside.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("beside", "n")).alias("c"))  # at most (classes + 1)^2 entries
    e = F.crc32(F.substring(F.col("word").cast("string"), -2, 2).cast("binary")) % p.endings
    words = materialize(per.mapInArrow(choose, "word binary, n long, cls int").withColumn("e", e.cast("int")), "lm-tail")
    table = np.zeros((p.endings, c), np.int64)
    for r in words.where("n = 1 AND cls IS NOT NULL").groupBy("e", "cls").count().toLocalIterator():  # at most endings x classes rows
        table[r[0], r[1]] = r[2]
    usual = int(table.sum(axis=0).argmax()) or min(1, c - 1)
    endings = np.where(table.any(axis=1), table.argmax(axis=1), usual)
    spark = ids.sparkSession
    by_end = F.broadcast(spark.createDataFrame([(i, int(k)) for i, k in enumerate(endings)], "e int, end int"))
    words = words.join(by_end, "e").select("word", "n", F.coalesce("cls", "end").alias("cls"))
    places = places.withColumn("e", e.cast("int")).join(by_end, "e").select("uid", "k", "word", "end")
    return places, words, endings


FILLED = "uid long, doc_id long, held boolean, cls binary, n_known long, known double"


def _filled(ids: DataFrame, places: DataFrame, words: DataFrame, of: np.ndarray, counts: np.ndarray) -> DataFrame:
    """FILLED: the class of each token as a byte, known tokens, and the sum of log10(count + 1)."""
    sent = ids.sparkSession.sparkContext.broadcast((np.where(of < 0, UNKNOWN, of).astype(np.uint8), np.append(np.log10(counts + 1.0), 0.0)))
    end = int(counts[0] > 0)

    def head(batches):
        cls, plus = sent.value
        for b in batches:
            for part in slices(b, 3, 1 << 20, 16 << 20):
                ks = [np.frombuffer(x, "<i4") for x in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array([cls[k].tobytes() for k in ks], pa.binary()),
                    pa.array([int((k >= 0).sum()) + end for k in ks], pa.int64()), pa.array([float(plus[k].sum() + plus[0]) for k in ks], pa.float64())], names=["uid", "doc_id", "held", "cls", "n_known", "known"])

    def tail(batches):
        for b in batches:
            at, found = b.column(6).offsets.to_numpy(), b.column(6).flatten()
            place, new = found.field("k").to_numpy(), found.field("cls").to_numpy().astype(np.uint8)
            seen = found.field("n").fill_null(0).to_numpy()
            plus, own = np.append(0.0, np.cumsum(np.log10(seen + 1.0))), np.append(0, np.cumsum(seen > 0))
            at = at - at[0]
            cls = []
            for raw, i, j in zip(b.column(3).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if i < j:
                    k = np.frombuffer(raw, np.uint8).copy()
                    k[np.flatnonzero(k == UNKNOWN)[place[i:j]]] = new[i:j]
                    raw = k.tobytes()
                cls.append(raw)
            known = b.column(4).to_numpy() + own[at[1:]] - own[at[:-1]]
            total = b.column(5).to_numpy() + plus[at[1:]] - plus[at[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cls, pa.binary()), pa.array(known, pa.int64()), pa.array(total, pa.float64())], names=["uid", "doc_id", "held", "cls", "n_known", "known"])

    found = places.join(words, "word", "left").groupBy("uid").agg(F.collect_list(F.struct("k", F.coalesce("cls", "end").alias("cls"), "n")).alias("found"))
    rows = ids.select("uid", "doc_id", "held", "ids").mapInArrow(head, FILLED)
    return rows.join(found, "uid", "left").mapInArrow(tail, FILLED)


def train(docs: DataFrame, p: BrownParams) -> dict:
    """The model of the rows (uid, doc_id, text, held) that aren't held: filled (all rows), words with their counts and
    classes, tail (the words without a number), endings, log_trans, log_class, size, total."""
    spark = docs.sparkSession
    rows = docs.select("uid", "doc_id", F.col("text").cast("binary").alias("text"), "held")
    vocab = materialize(word_counts(rows.where("NOT held").select("text"), p.flush), "lm-words")
    size, total = vocab.agg(F.count(F.lit(1)), F.sum("n")).first()
    # the least count that at most head words reach, and 2 at least: words seen once tell what unseen ones are like
    least, have = 2, 0
    kinds = vocab.where("n > 1 AND length(word) > 0").groupBy("n").count().collect()  # k different counts need k^2 / 2 tokens
    for n, words in sorted(map(tuple, kinds), reverse=True):
        have += words
        if have > p.head:
            least = n + 1
            break
    top = vocab.where(F.col("n") >= least).where("length(word) > 0").toArrow().to_pylist()  # at most head rows
    top.sort(key=lambda r: (-r["n"], r["word"]))
    ends = vocab.where("length(word) = 0").agg(F.sum("n")).first()[0] or 0
    words = spark.sparkContext.broadcast([b"", *(r["word"] for r in top)])
    counts = np.array([ends, *(r["n"] for r in top)], np.int64)
    del top
    ids = materialize(numbered(rows, words), "lm-ids")
    known = ids.where("NOT held")
    of = cluster(known, counts, p)
    c = p.classes
    places, tail, endings = tail_words(ids, of, _transitions(known, of, c), p)
    filled = materialize(_filled(ids, places, tail, of, counts), "lm-classes")

    def pairs(batches):
        out = np.zeros(c * c, np.int64)
        for b in batches:
            for part in slices(b, 0, 1 << 20, 16 << 20):
                k = np.frombuffer(b"\0" + b"\0".join(part.column(0).to_pylist()) + b"\0", np.uint8).astype(np.int64)
                out += np.bincount(k[:-1] * c + k[1:], minlength=c * c)
        yield _sparse(out)

    trans = _gather(filled.where("NOT held").select("cls").mapInArrow(pairs, "k long, n long"), c * c).reshape(c, c)
    tokens, kinds = np.bincount(of[:-1], counts, c), np.bincount(of[:-1], minlength=c).astype(float)
    for r in tail.groupBy("cls").agg(F.sum("n"), F.count(F.lit(1))).toLocalIterator():  # one row a class
        tokens[r[0]] += r[1]
        kinds[r[0]] += r[2]
    marginal = (tokens + 1) / (tokens.sum() + c)
    log_trans = np.log10((trans + p.alpha * marginal[None, :]) / (trans.sum(axis=1, keepdims=True) + p.alpha))
    log_class = np.log10(tokens + kinds + 1)  # one place in each class is for unseen words
    log_class[0] = 0.0
    release(ids)
    return {"filled": filled, "words": words, "of": of[:-1], "counts": counts, "tail": tail, "endings": endings, "trans": trans, "log_trans": log_trans, "log_class": log_class, "size": size, "total": total or 0, "end": float(np.log10(counts[0] + 1.0))}


def score(model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row that the model was made with."""
    filled = model["filled"]
    wide, end = float(np.log10(model["total"] + model["size"] + 1)), model["end"]
    sent = filled.sparkSession.sparkContext.broadcast((model["log_trans"], model["log_class"]))

    def run(batches):
        trans, cls = sent.value
        for b in batches:
            for part in slices(b, 2, 1 << 20, 16 << 20):
                n, base, score = [], [], []
                for raw, known in zip(part.column(2).to_pylist(), part.column(4).to_pylist()):
                    k = np.frombuffer(b"\0" + raw + b"\0", np.uint8)
                    n.append(len(raw) + 1)
                    base.append(known - n[-1] * wide)
                    # the end is alone in its class, so there the class says it all
                    score.append(known - end + float(trans[k[:-1], k[1:]].sum() - cls[k[1:]].sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), part.column(3), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = filled.select("doc_id", "held", "cls", "n_known", "known").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model["total"])).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, p: BrownParams | None = None) -> DataFrame:
    """Train on the documents outside the held-out fold and score all."""
    p = p or BrownParams()
    rows = pick(docs, "doc_id", "text").withColumn("held", crc_bucket(F.col("doc_id"), p.folds) == p.held_fold)
    return score(train(rows.withColumn("uid", F.monotonically_increasing_id()), p))
