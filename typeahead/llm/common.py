"""Helpers shared by the training-data operators: shared scratch tables and SQL snippets."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's
    checkpoint folder.  Only a local session without either gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; Hadoop removes it when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: work below is not repeated,
    lost executors only re-read files, and the planner knows the written size."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[str, Callable[[], None]] = {}  # what drops the caches of a kind of work, in this worker


def free_unused() -> None:
    """Give memory that was freed back to the system: Arrow's and the C library's pools hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def in_worker(kind: str, drop_caches: Callable[[], None] | None = None):
    """Decorates what a task runs over its batches.  Spark reuses Python workers: caches serve the
    further tasks of their kind, go before a worker takes up another, and a worker that waits holds
    no memory beside them."""
    def deco(fn):
        @wraps(fn)
        def task(batches, *args, **kwargs):
            for other in _kept.keys() - {kind}:
                _kept.pop(other)()
            if drop_caches:
                _kept[kind] = drop_caches
            try:
                yield from fn(batches, *args, **kwargs)
            finally:
                free_unused()
        return task
    return deco


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def id_remainder(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def text_key(text_col: str) -> Column:
    """Tells rows that share an id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


MAX_FILTER_BITS = 1 << 26  # 8 MB, the bound of what a key filter broadcasts


class KeyFilter(NamedTuple):
    """A bitmap of hashed keys: tells in a scan which rows cannot have one of the keys."""
    bitmaps: DataFrame  # bucket, bitmap (of 32,768 bits)
    bits: int

    def mark(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        """``df`` and a boolean ``out``: false where the row has none of the keys for sure.
        The bitmaps are broadcast, so the rows, with their texts, stay where they are."""
        bucket, bitmap = unused(df, "filter_bucket"), unused(df, "filter_bitmap")
        at = F.pmod(key, F.lit(self.bits).cast("long"))
        bit = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(at.bitwiseAND(F.lit(32767).cast("long")), 3).cast("int") + 1,
                                       F.lit(1))), 16, 10).cast("int")
        bit = bit.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0
        marked = df.withColumn(bucket, F.shiftright(at, 15)).join(
            F.broadcast(self.bitmaps.toDF(bucket, bitmap)), bucket, "left")
        return marked.withColumn(out, F.coalesce(bit, F.lit(False))).drop(bucket, bitmap)


def key_filter(keys: DataFrame, key: Column, label: str) -> KeyFilter:
    """16 bits a key, up to MAX_FILTER_BITS; beyond that more rows pass, and none is lost."""
    keys = keys.select(key.alias("k"))
    bits = min(MAX_FILTER_BITS, max(1 << 15, 1 << (16 * max(1, keys.count())).bit_length()))
    at = F.pmod(F.col("k"), F.lit(bits).cast("long"))
    bitmaps = stage(keys.groupBy(F.shiftright(at, 15).alias("bucket")).agg(
        F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767).cast("long"))).alias("bitmap")), label)
    return KeyFilter(bitmaps, bits)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named in ``kept`` (id, key), each once, columns unchanged."""
    key, kept_id, kept_key = (unused(docs, c) for c in ("row_key", "kept_id", "kept_key"))
    kept = kept.select(F.col("id").alias(kept_id), F.col("key").alias(kept_key)).distinct()
    rows = docs.withColumn(key, text_key(text_col))
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    # a merge join at every size: the rows kept grow with the table
    return rows.join(kept.hint("merge"), same, "left_semi").dropDuplicates([id_col, key]).drop(key)
