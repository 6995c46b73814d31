"""Operator 2: sharding by vector bin packing. Law: bytes (sizes near equal); groups of equal texts stay together.

Items are groups of equal texts as vectors (bytes, tokens, rows). Groups go, largest first, to the shard where the dot
product with the residual capacity is highest; a last pass moves items from the fullest to the emptiest shard while that
brings their bytes closer. A group stays whole unless it holds more of a total than a shard's mean: only such a group
is cut, by rows, into pieces of at most a quarter of the mean.

The driver sees a bounded number of items. A large group, with over 1/(shards * share) of a total, is an item of its own
(at most 3 * shards * share exist). Small groups of nearly the same vector (equal to 1/grid of an octave in each weight)
form a class; of a class only count and sums are gathered, and its groups are placed one after the other, several at a
time where they are so small that several weigh no more than one small group may. Groups find their place by their rank
in the class. The grid is made coarser until there are at most ``classes`` classes, which changes no rule, only by how
much vectors of one class may differ.

Edge cases: null text counts as empty (size 8) and groups with empty texts; repeated rows are rows of their own; ties
between shards go to the lowest number, between groups to the lower bytes of the digest; very long texts are counted
whole, and one beyond a shard's mean fills a shard alone; a null id is kept; an empty table gives an empty result; extra
columns, also with clashing names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, pick, release


@dataclass(frozen=True)
class ShardParams:
    shards: int = 24
    share: int = 200  # a large group holds more than 1/share of a shard's mean
    grid: int = 16  # classes of small groups in an octave of each weight
    classes: int = 100_000
    rows_a_run: int = 500  # rows (or groups of a class) numbered together, unless that makes over max_runs runs
    max_runs: int = 4096


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector, in the order given: the highest dot product with the residual capacity."""
    total = vectors.sum(axis=0)
    v = vectors / np.where(total > 0, total, 1)
    free = np.full((shards, v.shape[1]), 1.0 / shards)
    out = np.zeros(len(v), np.int64)
    for i in range(len(v)):
        k = int(np.argmax(free @ v[i]))
        out[i] = k
        free[k] -= v[i]
    return out


def polish(vectors: np.ndarray, where: np.ndarray, shards: int, moves: int = 4000) -> np.ndarray:
    """Move items from the fullest to the emptiest shard while their bytes come closer."""
    out = where.copy()
    load = np.bincount(out, weights=vectors[:, 0], minlength=shards)
    for _ in range(moves):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        own = np.flatnonzero(out == hi)
        size = vectors[own, 0]
        fit = np.flatnonzero((size > 0) & (size < gap))
        if not len(fit):
            break
        best = own[fit[np.argmin(np.abs(size[fit] - gap / 2))]]
        out[best] = lo
        load[hi] -= vectors[best, 0]
        load[lo] += vectors[best, 0]
    return out


def _starts(counts, of: str, kind: str):
    """(of, run, first) as a table: where each run begins, from counts (of, run, n) gathered in order."""
    out, at = [], {}
    for s, r, n in sorted(tuple(x) for x in counts.toLocalIterator()):
        out.append((s, r, at.get(s, 0)))
        at[s] = at.get(s, 0) + n
    return counts.sparkSession.createDataFrame(out, f"`{of}` {kind}, run int, first long")


def _rank(df: DataFrame, of: str, kind: str, order: str) -> DataFrame:
    """df (with of and run) with rank: a gapless number from 0 within of. Runs are numbered apart."""
    starts = _starts(df.groupBy(of, "run").agg(F.count(F.lit(1)).alias("n")), of, kind)
    local = F.row_number().over(Window.partitionBy(of, "run").orderBy(order)) - 1
    return df.withColumn("rank", local).join(F.broadcast(starts), [of, "run"]).withColumn("rank", (F.col("first") + F.col("rank")).cast("long")).drop("first", "run")


def shard(docs: DataFrame, p: ShardParams | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    p = p or ShardParams()
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.size(F.array_remove(F.split(text, SPACE + "+", -1), "")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"))
    rows = materialize(rows, "shard-rows")
    total = [max(t or 0, 1) for t in rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()]
    weights = ("b", "t", "n")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    part = F.greatest(*[F.col(w) / float(t) for w, t in zip(weights, total)])  # the largest share of a total
    level = [F.floor(F.log2(F.col(w) + 1.0) * p.grid).cast("long") for w in weights]
    groups = materialize(groups.withColumn("part", part).withColumn("level", F.array(*level)), "shard-groups")

    # large groups: items of their own; what no shard's mean can hold is cut
    least = 1.0 / (p.shards * p.share)
    large = sorted((bytes(r.digest), r.part, (r.b, r.t, r.n)) for r in groups.where(F.col("part") > least).toLocalIterator())
    cut = [(bytearray(d), int(np.ceil(4 * p.shards * w))) for d, w, v in large if w * p.shards > 1 and v[2] > 1]
    cuts = spark.createDataFrame(cut, "digest binary, pieces long")
    piece = F.pmod(F.xxhash64("uid"), F.col("pieces"))
    pieces = rows.join(F.broadcast(cuts), "digest").groupBy("digest", piece.alias("piece")).agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1)))
    items = [(d, -1, v) for d, w, v in large if not (w * p.shards > 1 and v[2] > 1)]
    items += sorted((bytes(r[0]), r[1], tuple(r)[2:]) for r in pieces.toLocalIterator())  # at most 12 shards + 4 for each cut group

    # small groups: classes of nearly equal vectors
    small = groups.where(F.col("part") <= least)
    coarse = 1
    while True:
        name = F.concat_ws("-", F.transform("level", lambda x: F.floor(x / coarse).cast("string")))
        classes = small.groupBy(name.alias("class")).agg(F.count(F.lit(1)).alias("groups"), *[F.sum(w).alias(w) for w in weights])
        if classes.limit(p.classes + 1).count() <= p.classes:
            break
        coarse *= 2
    table = sorted((r[0], r[1], tuple(r)[2:]) for r in classes.toLocalIterator())
    scale = np.array(total, float)
    vectors = [v for _, _, v in items]
    chunks = []  # class, number of the chunk, of groups placed at once
    step = {}
    for c, count, v in table:
        mean = np.array(v, float) / count
        step[c] = max(1, int(least / (mean / scale).max()))
        for k in range(0, count, step[c]):
            chunks.append((c, k // step[c], min(step[c], count - k)))
            vectors.append(mean * chunks[-1][2])
    v = np.array(vectors, float).reshape(len(vectors), 3)
    one = np.array([max(x) for x in (v / scale)] or [0.0])[: len(v)]
    one[len(items) :] /= np.array([c[2] for c in chunks] or [1.0])[: len(chunks)]  # the order goes by single groups
    order = np.lexsort((np.arange(len(v)), -one))
    where = np.zeros(len(v), np.int64)
    where[order] = place(v[order], p.shards)
    where = polish(v, where, p.shards).tolist()

    own = spark.createDataFrame([(bytearray(d), k, s) for (d, k, _), s in zip(items, where)], "digest binary, piece long, own int")
    plan = spark.createDataFrame([(c, k, s) for (c, k, _), s in zip(chunks, where[len(items) :])], "class string, chunk long, shard int")
    kinds = spark.createDataFrame([(c, step[c], max(1, min(p.max_runs, n // p.rows_a_run))) for c, n, _ in table], "class string, step long, runs long")
    named = small.select("digest", name.alias("class")).join(F.broadcast(kinds), "class").withColumn("run", F.pmod(F.xxhash64("digest"), F.col("runs")).cast("int"))
    ranked = _rank(named, "class", "string", "digest").withColumn("chunk", F.expr("rank DIV step"))
    chosen = ranked.join(F.broadcast(plan), ["class", "chunk"]).select("digest", F.col("shard"))
    chosen = materialize(chosen, "shard-chosen")

    dealt = rows.join(F.broadcast(cuts), "digest", "left").withColumn("piece", F.coalesce(piece, F.lit(-1).cast("long")))
    dealt = dealt.join(F.broadcast(own), ["digest", "piece"], "left").select("uid", "doc_id", "size", "text_crc32", "digest", "own")
    # a small group is no hot key: it holds less than 1 / (shards * share) of the rows
    rest = dealt.where("own IS NULL").join(chosen, "digest").select("uid", "doc_id", "size", "text_crc32", "shard")
    placed = dealt.where("own IS NOT NULL").select("uid", "doc_id", "size", "text_crc32", F.col("own").alias("shard")).unionByName(rest)
    runs = max(1, min(p.max_runs, total[2] // (p.shards * p.rows_a_run)))
    placed = materialize(placed.withColumn("run", F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(runs)).cast("int")), "shard-placed")
    release(rows, groups, chosen)
    out = _rank(placed, "shard", "int", "uid")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
