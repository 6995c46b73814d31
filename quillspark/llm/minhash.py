"""Operator 6: near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle is hashed into one of t bins and the smallest hash wins, only in bins that no earlier
round filled; rounds t .. 2t-1 fill bin i-t for certain. So all t coordinates are filled after about t log t hashes and
estimates concentrate. Coordinates are cut into bands; documents with an equal band are candidates, and links are
confirmed on the full shingle sets (64-bit hashes of shingles).

Documents with equal sets are one class, and a class is handled once. No bucket is expanded into its pairs. One order
over all bands, that of class ids, makes the first member of a bucket its hub. In the first round every class is compared
with one hub only, the one it shares most bands with; components are found. In the second round the hubs of other
components follow. In buckets that still hold several components, members of different components are compared
completely, block by block, so no link between candidates that would join two components is lost; a task holds two
blocks and gives back a spanning forest of the links it found. Keys that many rows share are dealt to several tasks.

Edge cases: null, empty and blank texts have an empty set and link with nothing; with fewer words than a shingle the
whole sequence is one shingle; very long texts are used whole; repeated rows are one class; a null id is kept (and is
its component only if no row of the group has an id); ties (rows of a group with the same smallest id) all count as
kept in near_duplicates, and the one read first stays in keep_one; an empty table gives an empty result; extra columns,
also with clashing names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, join_hot, materialize, pick, release, slices


@dataclass(frozen=True)
class MinHashParams:
    words: int = 5
    percent: int = 80
    bands: int = 64
    band_size: int = 8
    filter_bits: int = 1 << 24  # of the filter of texts that are read again
    band_bits: int = 1 << 26  # of the filter of bands that occur twice
    block: int = 2048  # members of a bucket compared at once
    block_shingles: int = 2_000_000  # shingles of a block, unless one member has more
    cache: int = 100_000  # words whose hashes a task remembers


M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts given as UTF-8 bytes."""

    def __init__(self, k: int, cache: int):
        import xxhash

        self.k, self.most, self.seen, self.hash = k, cache, {}, xxhash.xxh3_64_intdigest

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.lower().split() for t in texts]  # bytes: lowers A-Z, splits at ASCII white space
        if len(self.seen) > self.most:
            self.seen.clear()
        new = {w for ws in split for w in ws if w not in self.seen}
        self.seen.update(zip(new, map(self.hash, new)))
        get = self.seen.__getitem__
        out = []
        for ws in split:
            n = min(self.k, len(ws))
            if not n:
                out.append(np.empty(0, np.uint64))
                continue
            h = np.fromiter(map(get, ws), np.uint64, len(ws))
            last = len(h) - n + 1
            s = np.full(last, n, np.uint64)
            for i in range(n):
                s = mix(s * M3 + h[i : last + i])
            out.append(np.unique(s))
        return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: documents x t."""
    docs = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, docs)
    x = np.concatenate(sets) if docs else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(docs), sizes)
    out, empty = np.full(docs * t, np.iinfo(np.uint64).max, np.uint64), np.ones(docs * t, bool)
    shift = np.uint64(64 - (t - 1).bit_length())
    for i in range(t):
        h = mix(x + np.uint64((i + 1) * int(M3) & 0xFFFFFFFFFFFFFFFF))
        at = doc * t + ((h >> shift).astype(np.int64) % t)
        free = empty[at]
        np.minimum.at(out, at[free], h[free])
        empty[at[free]] = False
        if i % 4 == 3 or i > 32:
            open_ = empty.reshape(docs, t).any(axis=1)
            if not open_.any():
                return out.reshape(docs, t)
            stay = open_[doc]
            if not stay.all():
                x, doc = x[stay], doc[stay]
    grid, left = out.reshape(docs, t), empty.reshape(docs, t)
    for d in np.flatnonzero(left.any(axis=1)):  # few and small: a set of n misses a bin with probability e^-n
        j = np.flatnonzero(left[d])
        grid[d, j] = mix(sets[d][:, None] + (np.uint64(t + 1) + j.astype(np.uint64))[None, :] * M3).min(axis=0)
    return grid


def band_keys(grid: np.ndarray, bands: int, size: int) -> np.ndarray:
    g = grid[:, : bands * size].reshape(len(grid), bands, size)
    h = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + M1), g.shape[:2]).copy()
    for i in range(size):
        h = mix(h * M3 + g[:, :, i])
    return h


def _text_key(t: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(t, seed=11)


SKETCHED = "uid long, doc_id long, set_key binary, n_shingles long, text_key long, bands array<long>"


def sketched(rows: DataFrame, p: MinHashParams) -> DataFrame:
    """rows (uid, doc_id, text as binary) -> SKETCHED."""
    t = p.bands * p.band_size

    def run(batches):
        import hashlib

        shingler = Shingler(p.words, p.cache)
        for b in batches:
            for part in slices(b, 2, 400):
                text = [x or b"" for x in part.column(2).to_pylist()]
                sets = shingler.sets(text)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(sketch([sets[i] for i in full], t), p.bands, p.band_size).view(np.int64)
                bands: list = [None] * len(sets)
                for i, k in zip(full, keys):
                    bands[i] = k
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([_text_key(x) for x in text], np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                    names=["uid", "doc_id", "set_key", "n_shingles", "text_key", "bands"])

    return rows.mapInArrow(run, SKETCHED)


def _bitmap(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """Filter of fixed size over the values of a long column, gathered from at most bits / 32768 rows of 4 KB."""
    v = F.pmod(F.col(key), F.lit(bits))  # the key is a hash
    rows = df.select((v + 1).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("b"))
    out = np.zeros((bits // 32768 + 2) * 32768, np.uint8)
    for k, b in rows.toLocalIterator():
        out[(k - 1) * 32768 : k * 32768] = np.unpackbits(np.frombuffer(bytes(b), np.uint8), bitorder="little")
    return np.packbits(out)


def _members(classes: DataFrame, p: MinHashParams) -> DataFrame:
    """(cid, n, band) of the bands that may occur in two classes: those of a fixed-size filter of the repeated ones.

    Bands are counted by their lower half: two that share it count as repeated, which only keeps more of them."""
    low = F.transform("bands", lambda b: b.bitwiseAND(F.lit(0xFFFFFFFF)))
    twice = classes.select(F.explode(low).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    sent, size = classes.sparkSession.sparkContext.broadcast(_bitmap(twice, "band", p.band_bits)), p.band_bits

    def run(batches):
        bits = sent.value
        for b in batches:
            flat, of = b.column(2).flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
            pos = (flat.view(np.uint64) % np.uint64(size)).astype(np.int64)
            hit = np.flatnonzero((bits[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of[hit])), b.column(1).take(pa.array(of[hit])), pa.array(flat[hit])], names=["cid", "n", "band"])

    return classes.select("cid", "n", "bands").mapInArrow(run, "cid long, n long, band long")


def _full_sets(rows: DataFrame, classes: DataFrame, p: MinHashParams) -> DataFrame:
    """The shingle sets s of classes (set_key, text_key and other columns), made again from the texts that may hold them."""
    sent, size = rows.sparkSession.sparkContext.broadcast(_bitmap(classes, "text_key", p.filter_bits)), p.filter_bits

    def run(batches):
        import hashlib

        bits, shingler, done = sent.value, Shingler(p.words, p.cache), set()
        for b in batches:
            column = b.column(2)
            keys = np.fromiter((_text_key(x.as_py() or b"") for x in column), np.uint64, len(column))
            pos = (keys % np.uint64(size)).astype(np.int64)
            hit = np.flatnonzero((bits[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            if len(done) > 200_000:
                done.clear()
            text = []
            for i in hit.tolist():
                k = int(keys[i])
                if k not in done:  # copies of a text in a task go once
                    done.add(k)
                    text.append(column[i].as_py() or b"")
            for part in slices(pa.record_batch([pa.array(text, pa.binary())], ["t"]), 0, 400):
                out = [s for s in shingler.sets(part.column(0).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in out], pa.binary()),
                    pa.array([s.view(np.int64) for s in out], pa.list_(pa.int64()))], names=["set_key", "s"])

    found = rows.mapInArrow(run, "set_key binary, s array<long>").groupBy("set_key").agg(F.first("s").alias("s"))
    return classes.join(found, "set_key").drop("set_key", "text_key")


def _similar(left: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Of left (cid, n, s, hub, hub_n) the (cid, hub) whose sets reach the similarity. hubs: hub, its set t, and pairs, the
    number of rows of left that name it, which may be many."""
    total = hubs.agg(F.sum("pairs")).first()[0] or 0
    both = join_hot(left, hubs, "hub", "pairs", total, "cid").withColumn("c", F.size(F.array_intersect("s", "t")))
    return both.where(100 * F.col("c") >= percent * (F.col("n") + F.col("hub_n") - F.col("c"))).select("cid", "hub")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (cid, n, hub, hub_n) whose sets reach the similarity, as (cid, hub)."""
    hubs = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("pairs"))
    hubs = materialize(hubs.join(sets.select(F.col("cid").alias("hub"), F.col("s").alias("t")), "hub"), "near-hubs")
    return _similar(pairs.join(sets.select("cid", "s"), "cid"), hubs, percent)


def _forest(near: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows and columns of a spanning forest, over the labels, of the links in the symmetric matrix near: 2 x links."""
    i, j = np.nonzero(np.triu(near, 1))
    names, of = np.unique(label, return_inverse=True)
    link = np.full((len(names), len(names)), -1, np.int32)
    link[of[i], of[j]] = link[of[j], of[i]] = np.arange(len(i))
    out, open_ = [], np.ones(len(names), bool)
    for start in range(len(names)):
        todo = [start] if open_[start] else []
        open_[start] = False
        while todo:
            x = todo.pop()
            new = np.flatnonzero((link[x] >= 0) & open_)
            open_[new] = False
            out += link[x, new].tolist()
            todo += new.tolist()
    return np.stack([i[out], j[out]]) if out else np.empty((2, 0), np.int64)


def _block_links(cid: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int, same: bool) -> np.ndarray:
    """Links within one block (or between two) of members in different components: exact, reduced to a spanning forest."""
    n = len(cid)
    size = np.fromiter(map(len, sets), np.int64, n)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)  # a shingle of one member is in no intersection
    new = np.full(len(count), -1, np.int64)
    new[shared] = np.arange(len(shared))
    col = new[inv]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((n, n), np.float32)
    for lo in range(0, len(shared), 4096):
        x, y = np.searchsorted(col, [lo, lo + 4096])
        part = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
        part[row[x:y], col[x:y] - lo] = 1
        common += part @ part.T
    near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    near &= label[:, None] != label[None, :]
    if not same:
        near &= side[:, None] != side[None, :]
    i, j = _forest(near, label)
    return np.stack([np.maximum(cid[i], cid[j]), np.minimum(cid[i], cid[j])])


def _blocks(rest: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """Links (cid, hub) in buckets (band, cid, label, k, shingles) with several components. Buckets are cut
    into blocks of about p.block members and p.block_shingles shingles; a task holds two blocks at most."""
    blocks = F.greatest(F.ceil(F.col("k") / p.block), F.ceil(F.col("shingles") / p.block_shingles), F.lit(1)).cast("long")
    m = rest.join(sets.select("cid", "s"), "cid").withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("nb")))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    m = m.select("band", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "cid", "label", "s")
    percent = p.percent

    def run(key, t):
        got = _block_links(t.column("cid").to_numpy(), t.column("label").to_numpy(), t.column("own").to_numpy(), [np.asarray(x.values, np.int64) for x in t.column("s")], percent, key[1].as_py() == key[2].as_py())
        return pa.table({"cid": got[0], "hub": got[1]})

    return m.groupBy("band", "i", "j").applyInArrow(run, "cid long, hub long")


def components(links: DataFrame) -> DataFrame:
    """(cid, label): label is the smallest cid of the component, for every cid that has a link (cid, hub). Star contraction."""

    def stamp(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(links.select(F.greatest("cid", "hub").alias("u"), F.least("cid", "hub").alias("v")).where("u <> v").distinct(), "near-edges")
    before = stamp(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree")), "near-least")
        large = join_hot(both.where("v > u"), least, "u", "degree", 2 * before[0], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "near-large")
        least2 = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")), "near-least")
        small = join_hot(large, least2, "u", "degree", before[0], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), "near-edges")
        release(e, least, large, least2)
        e, now = after, stamp(after)
        if now == before:
            return e.select(F.col("u").alias("cid"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("cid"), F.col("v").alias("label")).distinct())
        before = now


def _labelled(df: DataFrame, labels: DataFrame, key: str, out: str) -> DataFrame:
    """df with the label of the class in column key; classes without a link are their own."""
    names = labels.select(F.col("cid").alias("__c"), F.col("label").alias(out))
    return df.join(names, F.col(key) == F.col("__c"), "left").drop("__c").withColumn(out, F.coalesce(out, key))


def group(docs: DataFrame, p: MinHashParams, columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(verdicts, base). verdicts: uid, doc_id, n_shingles, component_id, stays. base: materialised uid and ``columns``."""
    base = pick(docs, *dict.fromkeys(("doc_id", "text", *columns)))
    if columns:
        base = materialize(base.withColumn("uid", F.monotonically_increasing_id()), "near-base")
        rows = base.select("uid", "doc_id", F.col("text").cast("binary").alias("text"))
    else:
        rows = base.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("binary").alias("text"))
    wide = materialize(sketched(rows, p), "near-bands")
    sketches = materialize(wide.select("uid", "doc_id", "n_shingles", "set_key"), "near-sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    full = sketches.where("n_shingles > 0")
    classes = wide.where("n_shingles > 0").groupBy("set_key").agg(F.min("uid").alias("cid"), F.min(first).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("text_key").alias("text_key"), F.first("bands").alias("bands"))
    classes = materialize(classes, "near-classes")
    release(wide)
    total, kinds = classes.agg(F.sum("copies"), F.count(F.lit(1))).first()

    # buckets of classes with an equal band; the smallest class id of a bucket is its hub
    member = materialize(_members(classes, p), "near-bands")
    buckets = member.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"), F.min("cid").alias("hub"), F.min_by("n", "cid").alias("hub_n")).where("k > 1")
    buckets = materialize(buckets.withColumn("weight", F.col("k")), "near-buckets")
    more = materialize(join_hot(member, buckets, "band", "weight", p.bands * (kinds or 0), "cid"), "near-members")
    sizes = 100 * F.least("n", "hub_n") >= p.percent * F.greatest("n", "hub_n")
    candidates = more.where("cid <> hub").where(sizes).groupBy("cid", "n", "hub", "hub_n").agg(F.count(F.lit(1)).alias("shared"))
    candidates = materialize(candidates, "near-candidates")
    # one hub for each class; its number and what counts its members travel with the sets, which so are dealt out once
    best = candidates.groupBy("cid").agg(F.max(F.struct("shared", (-F.col("hub")).alias("hub"), "hub_n")).alias("best"))
    best = materialize(best.select("cid", (-F.col("best.hub")).alias("hub"), "best.hub_n"), "near-best")
    members = best.groupBy(F.col("hub").alias("cid")).agg(F.count(F.lit(1)).alias("pairs"))
    involved = classes.select("cid", "n", "set_key", "text_key").join(more.select("cid").distinct(), "cid").join(best, "cid", "left").join(members, "cid", "left")
    involved = materialize(involved, "near-involved")
    sets = materialize(_full_sets(rows, involved, p), "near-sets")
    hubs = sets.where("pairs IS NOT NULL").select(F.col("cid").alias("hub"), F.col("s").alias("t"), "pairs")
    links = materialize(_similar(sets.where("hub IS NOT NULL").select("cid", "n", "s", "hub", "hub_n"), hubs, p.percent), "near-links")
    labels = materialize(components(links), "near-labels")
    # the other hubs, where they lie in another component
    left = _labelled(_labelled(candidates, labels, "cid", "x"), labels, "hub", "y").where("x <> y").select("cid", "n", "hub", "hub_n")
    left = materialize(left, "near-second")
    if not left.isEmpty():
        links = materialize(links.unionByName(verified(left, sets, p.percent)), "near-links")
        labels = materialize(components(links), "near-labels")

    # buckets that still hold several components; of two members the hub was compared with the other
    m = materialize(_labelled(more.where("k > 2").select("band", "cid", "k", "shingles"), labels, "cid", "label"), "near-labelled")
    # of buckets with the same members one is enough
    same = (F.count(F.lit(1)).alias("k"), F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.bit_xor(F.xxhash64("cid")).alias("sign"))
    torn = m.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), *same).where("x <> y")
    torn = torn.groupBy("k", "lo", "hi", "sign").agg(F.min("band").alias("band")).select("band")
    rest = materialize(m.join(torn, "band", "left_semi"), "near-torn")
    if not rest.isEmpty():
        links = links.unionByName(materialize(_blocks(rest, sets, p), "near-blocks"))
        labels = materialize(components(links), "near-labels")

    # the first row of each component; classes without a link keep their own
    reps = labels.join(classes.select("cid", "rep"), "cid").groupBy("label").agg(F.min("rep").alias("best"), F.count(F.lit(1)).alias("size"))
    reps = materialize(reps, "near-reps")
    named = join_hot(labels, reps, "label", "size", kinds or 0, "cid").select("cid", "best")
    found = classes.select("set_key", "cid", "rep", "copies").join(named, "cid", "left").select("set_key", F.coalesce("best", "rep").alias("best"), "copies")
    found = materialize(found, "near-components")
    out = join_hot(full.select("uid", "doc_id", "n_shingles", "set_key"), found, "set_key", "copies", total or 0, "uid")
    out = out.select("uid", "doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"), (F.col("best.uid") == F.col("uid")).alias("stays"))
    alone = sketches.where("n_shingles = 0").select("uid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    release(classes, member, buckets, more, candidates, best, involved, sets, left, m, rest)
    return out.unionByName(alone), base


def near_duplicates(docs: DataFrame, p: MinHashParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    verdicts, _ = group(docs, p or MinHashParams())
    return verdicts.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("stays")).alias("kept"))


def keep_one(docs: DataFrame, columns: tuple[str, ...], p: MinHashParams | None = None) -> DataFrame:
    """One row of each group, with ``columns``."""
    verdicts, base = group(docs, p or MinHashParams(), columns)
    gone = materialize(verdicts.where(~F.col("stays")).select("uid"), "near-gone")
    return drop_rows(base, gone).select(*columns)
