"""Contiguous, byte-balanced shards from global prefix sums.

Rows are range-partitioned and sorted by id; each partition reports its byte and row
totals; their exclusive prefix sums turn the running sums inside a partition into global
ones; a row goes to shard ``floor(bytes before it * n_shards / all bytes)``.  So shards
are contiguous in id order and each differs from the equal target by at most one row's size.

A null text has no bytes (its size is the per-row overhead), a null id sorts first, rows
with equal ids are ordered by size and checksum, an empty table gives no rows and other
columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage, table
from .queries import register

SCHEMA = "id long, size long, text_crc32 long, shard int, row long"


def byte_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id",
                text_col: str = "text", row_overhead: int = 8) -> DataFrame:
    """id, size, text_crc32 (unsigned), shard, slot (gapless from 0 within the shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"),
                         (F.octet_length(text) + F.lit(row_overhead)).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (narrow.repartitionByRange(parts, "id")
               .sortWithinPartitions("id", "size", "text_crc32")
               .withColumn("part", F.spark_partition_id())
               .withColumn("pos", F.monotonically_increasing_id()))
    ordered = stage(ordered, "shard-rows")

    # one row per partition, however many rows the table has
    totals = sorted(tuple(r) for r in ordered.groupBy("part").agg(F.sum("size"), F.count("*")).collect())
    before = dict(zip((p for p, _, _ in totals),
                      zip(accumulate([0] + [b for _, b, _ in totals]),
                          accumulate([0] + [n for _, _, n in totals]))))
    all_bytes = sum(b for _, b, _ in totals)

    def place(batches):
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            part = batch.column("part").to_numpy()
            size = batch.column("size").to_numpy()
            shard, row = np.empty(len(size), np.int32), np.empty(len(size), np.int64)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                b, n = seen.get(p, before[p])
                ends = b + np.cumsum(size[at])
                starts = ends - size[at]
                shard[at] = np.minimum(starts * n_shards // all_bytes, n_shards - 1)
                row[at] = n + np.arange(len(at))
                seen[p] = (int(ends[-1]), n + len(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("size"), batch.column("text_crc32"),
                 pa.array(shard), pa.array(row)], ["id", "size", "text_crc32", "shard", "row"])

    # pos is unique and rises with (part, id): one range shuffle puts each partition's rows
    # together again whatever splits the reader made
    rows = stage(ordered.repartition(parts, "part").sortWithinPartitions("pos").drop("pos")
                 .mapInArrow(place, SCHEMA), "shard-places")
    first = {r[0]: r[1] for r in rows.groupBy("shard").agg(F.min("row")).collect()}  # n_shards rows
    base = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("shard")) \
        if first else F.lit(0)
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                       (F.col("row") - base).cast("long").alias("slot"))


@register("op3_byte_shards")
def op3(spark, sf_dir):
    return byte_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
