"""Sequence packing by first-fit decreasing, with a tournament tree of bin capacities.

Each document becomes token ids plus an end id, cut into pieces of at most ``seq_len``.
Pieces are dealt at random (a seeded hash) into groups of about ``group_pieces``, and each
group is packed on its own: pieces by falling length, each into the first open sequence
with room, found in O(log n) through a tree whose nodes hold the larger capacity of their
two children.  A group's size does not depend on any key of the data, so no group is hot.

A null text is an empty one: its document is the end id alone.  Equal lengths are ordered
by id and start; rows that repeat a document are packed as often as they occur; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_worker, stage, table
from .queries import register
from .tokens import drop_encoders, encoder, slices

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


@in_worker("tokens", drop_encoders)
def cut_pieces(batches, tokenizer_path: str, end_id: int, seq_len: int):
    enc = encoder(tokenizer_path)
    for batch in batches:
        doc, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in slices(texts):
            ids, ends = enc.encode(texts[lo:hi], end_id)
            rows, first = [], 0
            for key, last in zip(doc[lo:hi], ends.tolist()):
                raw = ids[first:last].astype("<u4").tobytes()
                for s in range(0, last - first, seq_len):
                    piece = raw[4 * s:4 * (s + seq_len)]
                    rows.append((key, s, len(piece) // 4, zlib.crc32(piece), last - first))
                first = last
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             ["id", "start", "length", "ids_crc32", "doc_tokens"])
    enc.rest()


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of ``lengths``, which must already fall."""
    n = len(lengths)
    width = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * width)  # tree[1] is the root, bin b is leaf width + b
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < width:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[i], offsets[i] = node - width, capacity - tree[node]
        tree[node] -= length
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack_group(rows: pa.Table, seq_len: int) -> pa.Table:
    rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending")])
    bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), seq_len)
    group = rows.column("part")[0].as_py()
    return (rows.drop_columns(["part"])
            .append_column("sequence_id", pa.array((group << 32) + bins))
            .append_column("offset", pa.array(offsets)))


def pack_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = 1024, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", group_pieces: int = 20_000,
                   seed: int = 7) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = stage(rows.mapInArrow(partial(cut_pieces, tokenizer_path=tokenizer_path, end_id=end_id,
                                           seq_len=seq_len), PIECES), "pack-pieces")
    groups = max(1, pieces.count() // group_pieces)
    # monotonically_increasing_id tells repeated rows apart, so they spread over groups too
    part = F.pmod(F.xxhash64("id", "start", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups))

    def pack(rows: pa.Table) -> pa.Table:
        return pack_group(rows, seq_len)

    packed = pieces.withColumn("part", part).groupBy("part").applyInArrow(pack, PACKED)
    return packed.withColumnRenamed("id", id_col)


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op2_ffd_packing")
def op2(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
