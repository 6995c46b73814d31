"""Operator 7: exact deduplication by a log-structured merge index (native: DataFrame functions only).

Memtables are the map-side aggregates of a batch: they flush as digest-sorted Parquet runs, each with a filter (a bitmap
of fixed size over its digests). Compaction merges ``fan`` runs of a level into one of the next, level by level, until
one run is left. A digest is merged only if the filters say that another run of its merge may hold it; all others are
moved on as they are, without a shuffle. A merge keeps one identifier (smallest or largest) and the count. Rows whose
digest hits a digest seen twice are read again and their bytes are compared; groups whose bytes differ are regrouped by
the text itself, so a digest collision cannot merge different texts.

Edge cases: null text counts as empty and equals an empty text; rows that repeat with the same id are told apart by
their place in the materialised ledger, so one row of a group stays (ties go to the place); a null id loses against any
other; very long texts are digested whole; an empty table gives an empty result; extra columns, also with clashing names,
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, materialize, pick, release

#: Positions of the fixed-size bitmap filter: 2^23 bits, 256 rows of 4 KB, 1 MB whatever the input.
FILTER_BITS = 1 << 23


@dataclass(frozen=True)
class LsmParams:
    runs: int = 4
    fan: int = 2  # runs merged into one
    keep: str = "max"  # or "min"
    hot_share: int = 1000  # a digest with more than 1/hot_share of the rows is hot: at most hot_share of them exist


def _extreme(keep: str):
    return F.max if keep == "max" else F.min


def _identity(keep: str):
    """What the extreme is taken of: a null id loses on either side."""
    some = F.col("doc_id").isNotNull() if keep == "max" else F.col("doc_id").isNull()
    return F.struct(some.alias("some"), "doc_id", "uid")


def _merged(rows: DataFrame, keep, count, p: LsmParams) -> DataFrame:
    return rows.groupBy("run", "digest").agg(_extreme(p.keep)(keep).alias("keep"), count.alias("n"))


def flush(ledger: DataFrame, p: LsmParams) -> DataFrame:
    """Level 0: (run, digest, keep, n), each run in the order of its digests."""
    runs = ledger.withColumn("run", F.pmod(F.xxhash64("uid"), F.lit(p.runs)).cast("int"))
    rows = _merged(runs, _identity(p.keep), F.count(F.lit(1)), p)
    return materialize(rows.sortWithinPartitions("run", "digest"), "lsm-level0")


def filters(level: DataFrame) -> DataFrame:
    """(run, bucket, bits): the filter of each run, at most FILTER_BITS / 32768 + 1 rows of 4 KB a run."""
    pos = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    return level.select("run", pos.alias("v")).groupBy("run", F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))


def compact(level: DataFrame, p: LsmParams) -> DataFrame:
    """The next level: groups of ``fan`` runs become one. Digests that no other run of the group may hold skip the merge."""
    own = materialize(filters(level), "lsm-filters")
    first = F.expr(f"run DIV {p.fan} * {p.fan}")
    others = own.withColumn("to", F.explode(F.sequence(first, first + p.fan - 1))).where("to <> run")
    others = others.groupBy(F.col("to").cast("int").alias("run"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))  # at most runs * 257 rows of 4 KB
    marked = _looked_up(level, others)
    up = F.expr(f"run DIV {p.fan}").cast("int").alias("run")
    both = marked.where("hit").select(up, "digest", "keep", "n")
    alone = marked.where("NOT hit").select(up, "digest", "keep", "n")
    out = materialize(_merged(both, F.col("keep"), F.sum("n"), p).unionByName(alone).sortWithinPartitions("run", "digest"), "lsm-level")
    release(own, level)
    return out


def _looked_up(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """rows with hit: the filter (run, bucket, bits) holds the digest. No true member is missed."""
    d = rows.withColumn("__v", F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS)))
    d = d.join(F.broadcast(bits.withColumnsRenamed({"run": "__run", "bucket": "__bucket"})), (F.col("run") == F.col("__run")) & (F.bitmap_bucket_number("__v") == F.col("__bucket")), "left")
    return d.withColumn("hit", F.coalesce(_bit(), F.lit(False))).drop("__v", "__run", "__bucket", "bits")


def _bit():
    """The bit of position __v in bits."""
    at = F.bitmap_bit_position("__v").cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, F.pmod(at, F.lit(8))) == 1


def index(ledger: DataFrame, p: LsmParams) -> DataFrame:
    """(digest, keep, n): one row for each digest, from all levels."""
    level, runs = flush(ledger, p), p.runs
    while runs > 1:
        level, runs = compact(level, p), -(-runs // p.fan)
    return level


def dedup(docs: DataFrame, p: LsmParams | None = None, columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(verdicts, base). verdicts: uid, doc_id, digest, keep_id, group_size, kept for every row.

    base is the materialised table of uid and ``columns`` if columns are asked for, else the input.
    """
    p = p or LsmParams()
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    base = pick(docs, *dict.fromkeys(("doc_id", "text", *columns)))
    if columns:
        base = materialize(base.withColumn("uid", F.monotonically_increasing_id()), "exact-base")
        ledger = base.select("uid", "doc_id", digest.alias("digest"))
    else:
        ledger = base.select(F.monotonically_increasing_id().alias("uid"), "doc_id", digest.alias("digest"))
    ledger = materialize(ledger, "exact-ledger")
    rows = ledger.count()
    level = index(ledger, p)
    multi = materialize(level.where("n > 1").select("digest", "keep", "n"), "lsm-multi")
    release(level)

    # byte verification of the hits: a group is one text if its smallest and largest bytes are the same
    texts = base.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"), F.lit(0).alias("run"))
    hits = _looked_up(texts, filters(multi.withColumn("run", F.lit(0)))).where("hit").drop("hit", "run")
    checked = hits.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.count(F.lit(1)).alias("rows"))
    clash = materialize(checked.where("rows > 1 AND lo <> hi").select("digest"), "exact-clash")
    if clash.isEmpty():
        found = multi
        verdict_rows = ledger.withColumn("sub", F.lit(None).cast("string"))
        found = found.withColumn("sub", F.lit(None).cast("string"))
    else:  # colliding digests: the text itself takes part in the key
        both = hits.join(clash, "digest").select("doc_id", "digest", F.col("text").alias("sub"))
        texts = both.groupBy("digest", "doc_id", "sub").agg(F.count(F.lit(1)).alias("n"))
        named = ledger.join(clash, "digest", "left_semi")
        # rows of one id and digest with different texts share that id: rank them within (digest, id)
        order = named.selectExpr("*", "row_number() OVER (PARTITION BY digest, doc_id ORDER BY uid) AS k")
        slots = texts.selectExpr("digest", "doc_id", "sub", "explode(sequence(1L, n)) AS j").selectExpr("digest", "doc_id", "sub", "row_number() OVER (PARTITION BY digest, doc_id ORDER BY sub, j) AS k")
        exact = order.join(slots, (order.digest == slots.digest) & order.doc_id.eqNullSafe(slots.doc_id) & (order.k == slots.k)).select(order.uid, order.doc_id, order.digest, "sub")
        exact = materialize(exact, "exact-collisions")
        verdict_rows = ledger.join(clash, "digest", "left_anti").withColumn("sub", F.lit(None).cast("string")).unionByName(exact)
        again = exact.groupBy("digest", "sub").agg(_extreme(p.keep)(_identity(p.keep)).alias("keep"), F.count(F.lit(1)).alias("n"))
        found = multi.join(clash, "digest", "left_anti").withColumn("sub", F.lit(None).cast("string")).unionByName(again.where("n > 1").select("digest", "keep", "n", "sub"))
    found = found.select(F.col("digest").alias("f_digest"), F.col("sub").alias("f_sub"), "keep", "n")
    limit = max(1, rows // p.hot_share)
    hot = F.broadcast(found.where(F.col("n") > limit))  # at most hot_share rows
    key = lambda side: (F.col("digest") == F.col("f_digest")) & F.col("sub").eqNullSafe(F.col("f_sub"))
    first = verdict_rows.join(hot, key(hot), "left")
    done = first.where("n IS NOT NULL")
    rest = first.where("n IS NULL").drop("f_digest", "f_sub", "keep", "n")
    cold = found.where(F.col("n") <= limit)
    out = done.unionByName(rest.join(cold, key(cold), "left"))
    kept = F.coalesce(F.col("keep.uid") == F.col("uid"), F.lit(True))
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    verdicts = out.select("uid", "doc_id", "digest", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))
    return verdicts, base


def exact_dedup(docs: DataFrame, p: LsmParams | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    verdicts, _ = dedup(docs, p)
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, columns: tuple[str, ...], p: LsmParams | None = None) -> DataFrame:
    """The rows that stay, with ``columns``."""
    verdicts, base = dedup(docs, p, columns)
    gone = materialize(verdicts.where(~F.col("kept")).select("uid"), "exact-gone")
    return drop_rows(base, gone).select(*columns)
