"""Helpers shared by the operators of this subpackage: column picking, shared-folder tables, size checks, hot keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words: space and TAB..CR.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_TYPES = {"doc_id": "bigint", "n_chars": "bigint", "page_id": "bigint"}


#: A key with more rows than this, and than a thousandth of all, is hot.
HOT_ROWS = 64


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode alone an unset one becomes a temporary folder,
    which goes with the process; on a cluster that would be each machine's own, so an unset one is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that materialize wrote. Only for those that nothing returned or still to be computed reads."""
    for t in tables:
        path = t.__dict__.get("_table")
        if path:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts hold at most ``size`` bytes together, but one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        stop = min(max(stop, at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def join_hot(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, spread: str) -> DataFrame:
    """big join small on key, where small has one row for each key and ``weight`` counts the rows of big that have it.

    Hot keys (at most a thousand, as each has over a thousandth of ``total`` rows) are gathered and dealt to several tasks
    by a hash of the column ``spread``; the rows of small are repeated for them. Column ``weight`` is dropped.
    """
    each = max(HOT_ROWS, total // 1000)
    hot = [(r[0], int(-(-r[1] // each))) for r in small.where(F.col(weight) > each).select(key, weight).collect()]
    small = small.drop(weight)
    if not hot:
        return big.join(small, key)
    kind = T.StructType([T.StructField(key, small.schema[key].dataType), T.StructField("__parts", T.LongType())])
    parts = F.broadcast(small.sparkSession.createDataFrame(hot, kind))
    n = F.coalesce("__parts", F.lit(1))
    left = big.join(parts, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), n).cast("long")).drop("__parts")
    right = small.join(parts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("__parts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def drop_rows(base: DataFrame, gone: DataFrame, key: str = "uid", limit: int = 2_000_000) -> DataFrame:
    """Rows of base whose long key is not in gone: by a broadcast of at most ``limit`` keys (16 MB), beyond it by a shuffle."""
    gone = gone.select(key)
    return base.join(F.broadcast(gone) if small(gone, limit) else gone, key, "left_anti")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name and first position, whatever else the frame carries.

    Extra columns, repeated names and names that differ in case are ignored; a missing column becomes null.
    """
    have = df.columns
    plain = df.toDF(*[f"__{i}" for i in range(len(have))])
    cols = []
    for n in names:
        kind = _TYPES.get(n, "string")
        src = F.col(f"__{have.index(n)}") if n in have else F.lit(None)
        cols.append(src.cast(kind).alias(n))
    return plain.select(*cols)


def crc_bucket(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def small(df: DataFrame, limit: int) -> bool:
    """True if df has at most limit rows: the size check in front of a broadcast."""
    return df.limit(limit + 1).count() <= limit
