"""Token ids in binary files, compressed by an adaptive context-mixing range coder.

Each id's code range is mixed from three predictors: the id that last followed the two ids
before (order 2), the one that last followed the id before (order 1), and the frequencies of
the block's ids so far (order 0, taken in at checkpoints).  Orders 2 and 1 share the range by
the hit rates seen so far at their present confidence, order 0 has the rest and divides it by
frequency.  A carry-less range coder writes 16-bit words.  Every block starts from a reset model and carries a CRC of its ids; many
blocks are coded in step, one NumPy lane each.

File: magic; blocks (header, payload); an Arrow table of documents (id, tokens); a footer with
that table's place, length and CRC.  Files follow each other in ascending document id.

Null text is an empty one: the end id alone.  A null document id sorts first; rows that
repeat an id are kept, ordered by text length; an empty table writes no file; other columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .binpack import tokenizer_file
from .common import scratch, stage, table
from .queries import register
from .tokens import encoder, slices

MAGIC = b"CTXMIX01"
HEADER = struct.Struct("<III")   # ids, payload words, CRC of the ids
FOOTER = struct.Struct("<QQQI")  # vocabulary size; document table: place, length, CRC
BLOCK = 8192                     # ids per block
LANES = 1024                     # blocks coded in step
SLOTS1, SLOTS2 = 1 << 12, 1 << 13
CONFIDENT = 7
TOTAL = 1 << 16                  # what orders 2, 1 and 0 share
SEEN = 24                        # weight of a seen id against a never seen one
CHECKPOINTS = frozenset([16, 32, 64, 128, 256, 512, *range(1024, BLOCK, 1024)])

TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
U16, U48 = np.uint64(16), np.uint64(48)


class Mixer:
    """The models of ``n`` lanes, all freshly reset, for ids below ``vocab``."""

    def __init__(self, n: int, vocab: int):
        self.n, self.vocab = n, vocab
        self.below = np.empty((n, vocab + 1), np.uint32)  # order 0: weights of all smaller ids
        self.below[:] = np.arange(vocab + 1)
        self.flat = self.below.reshape(-1)
        # orders 1 and 2, one after the other: slots of all lanes, then hit rates by
        # confidence (zero stands for a slot never filled)
        self.guess = np.zeros(n * (SLOTS1 + SLOTS2), np.int32)
        self.sure = np.zeros(n * (SLOTS1 + SLOTS2), np.int8)
        self.rate = np.tile(np.append(0.0, np.full(CONFIDENT, 0.3)), 2 * n)
        lane = np.arange(n)
        self.slot_base = np.stack([lane * SLOTS1, n * SLOTS1 + lane * SLOTS2])
        self.rate_base = np.stack([lane, n + lane]) * (CONFIDENT + 1)
        self.last = np.zeros((2, n), np.int64)  # the id before, and a hash of the two before

    def start(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Look up the predictions for the next id of the first ``k`` lanes; returns the bounds
        of order 2's and order 1's shares of ``TOTAL``."""
        slot = self.last[:, :k] * 40503 >> 4
        slot[0] &= SLOTS1 - 1
        slot[1] &= SLOTS2 - 1
        slot += self.slot_base[:, :k]
        self.slot, self.level = slot, self.sure[slot]
        self.at_rate = self.rate_base[:, :k] + self.level
        self.said = self.guess[slot]
        self.hits = self.rate[self.at_rate]
        one, two = self.hits
        # order 2 first, order 1 with what it leaves; where they agree order 2 has both shares
        both = two + one * (1.0 - two)
        two = np.where(self.said[0] == self.said[1], both, two)
        return (two * (TOTAL * 0.98)).astype(np.uint64), (both * (TOTAL * 0.98)).astype(np.uint64)

    def finish(self, ids: np.ndarray) -> None:
        """Adapt both predictors to the ids."""
        k, level = len(ids), self.level
        filled = level > 0
        hit = (self.said == ids) & filled
        self.rate[self.at_rate] = self.hits + (hit - self.hits) * filled * (1 / 32)
        self.sure[self.slot] = np.where(hit, np.minimum(level + 1, CONFIDENT), np.maximum(level >> 1, 1))
        self.guess[self.slot] = np.where(level <= 2, ids, self.said)
        self.last[1, :k] = self.last[0, :k] * 30011 + ids * 7
        self.last[0, :k] = ids

    def recount(self, ids: np.ndarray) -> None:
        """Take the ids so far, one row per step, into order 0."""
        k, v = ids.shape[1], self.vocab
        for lo in range(0, k, 32):
            part = ids[:, lo:lo + 32]
            m = part.shape[1]
            counts = np.bincount((part + np.arange(m) * v).ravel(), minlength=m * v).reshape(m, v)
            counts *= SEEN
            counts += 1
            np.cumsum(counts, axis=1, out=counts)
            self.below[lo:lo + m, 1:] = counts

    def find(self, lanes: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The id whose order-0 interval holds ``value``, by binary search."""
        row = lanes * (self.vocab + 1)
        at = np.zeros(len(lanes), np.int64)
        for bit in reversed(range(self.vocab.bit_length())):
            probe = at + (1 << bit)
            at = np.where((probe < self.vocab) & (self.flat[row + np.minimum(probe, self.vocab)] <= value), probe, at)
        return at


class Coder:
    """Ranges of ``n`` lanes."""

    def __init__(self, n: int):
        self.low, self.width = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))

    def narrow(self, lanes, part: np.ndarray, below: np.ndarray, upto: np.ndarray) -> None:
        self.low[lanes] += part * below
        self.width[lanes] = part * (upto - below)

    def due(self, lanes) -> np.ndarray:
        """Which of ``lanes`` must shift a word; narrows ranges that straddle a word."""
        low, width = self.low[lanes], self.width[lanes]
        settled = (low ^ (low + width)) < TOP
        at = np.flatnonzero(settled | (width < BOTTOM))
        if isinstance(lanes, slice):
            found = at
        else:
            found = lanes[at]
        straddling = found[~settled[at]]
        if len(straddling):
            self.width[straddling] = (np.uint64(0) - self.low[straddling]) & (BOTTOM - np.uint64(1))
        return found

    def settle(self, k: int, move) -> None:
        """Shift words until every range is wide; ``move`` is told which lanes, before."""
        at = self.due(slice(0, k))
        while len(at):
            move(at)
            self.low[at] <<= U16
            self.width[at] <<= U16
            at = self.due(at)


def encode_blocks(blocks: list[np.ndarray], vocab: int) -> list[np.ndarray]:
    """16-bit words of each block; blocks come longest first."""
    n = len(blocks)
    lengths = np.array([len(b) for b in blocks])
    ids = np.zeros((lengths.max(), n), np.int64)
    for i, b in enumerate(blocks):
        ids[:len(b), i] = b
    model, coder = Mixer(n, vocab), Coder(n)
    out, used = np.empty((n, 2 * lengths.max() + 64), np.uint16), np.zeros(n, np.int64)

    def put(at: np.ndarray) -> None:
        out[at, used[at]] = coder.low[at] >> U48
        used[at] += 1

    for t in range(lengths.max()):
        k = int(np.searchsorted(-lengths, -t))
        if t in CHECKPOINTS:
            model.recount(ids[:t, :k])
        if used.max() + 16 >= out.shape[1]:
            out = np.concatenate([out, np.empty_like(out)], axis=1)
        first, second = model.start(k)
        now = ids[t, :k]
        by2, by1 = now == model.said[1], now == model.said[0]
        by2 &= first > 0
        by1 &= ~by2 & (second > first)
        below = np.where(by2, np.uint64(0), np.where(by1, first, second))
        upto = np.where(by2, first, np.where(by1, second, np.uint64(TOTAL)))
        coder.narrow(slice(0, k), coder.width[:k] >> U16, below, upto)
        rest = np.flatnonzero(~(by2 | by1))
        if len(rest):
            row = rest * (vocab + 1)
            at = row + now[rest]
            coder.narrow(rest, coder.width[rest] // model.flat[row + vocab], model.flat[at].astype(np.uint64),
                         model.flat[at + 1].astype(np.uint64))
        coder.settle(k, put)
        model.finish(now)
    for _ in range(4):
        put(np.arange(n))
        coder.low <<= U16
    return [out[i, :used[i]].copy() for i in range(n)]


def decode_blocks(words: list[np.ndarray], lengths: np.ndarray, vocab: int) -> list[np.ndarray]:
    """Ids of blocks that hold ``lengths`` ids each; blocks come longest first."""
    n, longest = len(words), int(lengths.max())
    data = np.zeros((n, max(map(len, words)) + 8), np.uint16)
    for i, w in enumerate(words):
        data[i, :len(w)] = w
    model, coder = Mixer(n, vocab), Coder(n)
    code = np.zeros(n, np.uint64)
    for i in range(4):
        code = code << U16 | data[:, i].astype(np.uint64)
    used, last = np.full(n, 4), data.shape[1] - 1
    ids = np.zeros((longest, n), np.int64)

    def take(at: np.ndarray) -> None:
        code[at] = code[at] << U16 | data[at, np.minimum(used[at], last)].astype(np.uint64)
        used[at] += 1

    for t in range(longest):
        k = int(np.searchsorted(-lengths, -t))
        if t in CHECKPOINTS:
            model.recount(ids[:t, :k])
        first, second = model.start(k)
        part = coder.width[:k] >> U16
        value = np.minimum((code[:k] - coder.low[:k]) // part, np.uint64(TOTAL - 1))
        by2, by1 = value < first, value < second
        now = np.where(by2, model.said[1], model.said[0])
        below = np.where(by2, np.uint64(0), np.where(by1, first, second))
        upto = np.where(by2, first, np.where(by1, second, np.uint64(TOTAL)))
        coder.narrow(slice(0, k), part, below, upto)
        rest = np.flatnonzero(~by1)
        if len(rest):
            row = rest * (vocab + 1)
            whole = model.flat[row + vocab].astype(np.uint64)
            part = coder.width[rest] // whole
            value = np.minimum((code[rest] - coder.low[rest]) // part, whole - np.uint64(1))
            found = model.find(rest, value)
            now[rest] = found
            at = row + found
            coder.narrow(rest, part, model.flat[at].astype(np.uint64), model.flat[at + 1].astype(np.uint64))
        coder.settle(k, take)
        ids[t, :k] = now
        model.finish(now)
    return [ids[:m, i].astype(np.uint32) for i, m in enumerate(lengths)]


# --- files ----------------------------------------------------------------------------------

def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class IdWriter:
    """One file; ids are buffered until ``LANES`` blocks can be coded in step."""

    def __init__(self, folder: str, name: str, vocab: int):
        self.vocab = vocab
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.final = f"{folder}/{name}", f"{root}/{name}"
        self.temp = f"{root}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.out.write(MAGIC)
        self.place, self.held, self.size = len(MAGIC), [], 0
        self.docs, self.lengths, self.total = [], [], 0

    def add(self, docs: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs += docs
        self.lengths += lengths.tolist()
        self.total += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        while self.size >= LANES * BLOCK:
            self.flush(LANES * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.held)
        blocks = [ids[i:min(n, i + BLOCK)] for i in range(0, n, BLOCK)]
        for block, words in zip(blocks, encode_blocks(blocks, self.vocab)):
            data = HEADER.pack(len(block), len(words), checksum(block)) + words.astype("<u2").tobytes()
            self.out.write(data)
            self.place += len(data)
        self.held, self.size = [ids[n:]], len(ids) - n

    def close(self) -> pa.RecordBatch:
        if self.size:
            self.flush(self.size)
        docs = pa.table({"id": pa.array(self.docs, pa.int64()), "n": pa.array(self.lengths, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_table(docs)
        data = sink.getvalue().to_pybytes()
        self.out.write(data + FOOTER.pack(self.vocab, self.place, len(data), zlib.crc32(data)))
        self.out.close()
        self.fs.move(self.temp, self.final)
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([self.total])], ["path", "tokens"])


def write_ids(batches, folder: str, tokenizer_path: str, end_id: int):
    writer, enc = None, encoder(tokenizer_path)
    vocab = max(len(enc.n_bytes), end_id + 1)
    if vocab > 1 << 16:
        raise ValueError("ids are held in 16 bits")
    for batch in batches:
        writer = writer or IdWriter(folder, f"ids-{TaskContext.get().partitionId():06d}.bin", vocab)
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in slices(texts):
            ids, ends = enc.encode(texts[lo:hi], end_id)
            writer.add(docs[lo:hi], ids.astype(np.uint16), np.diff(ends, prepend=0))
    if writer:
        yield writer.close()


def read_blocks(path: str, f, end: int, vocab: int):
    """The ids of all blocks in order, ``LANES`` blocks decoded in step."""
    place = len(MAGIC)
    while place < end:
        words, lengths, sums = [], [], []
        while place < end and len(words) < LANES:
            f.seek(place)
            n, size, crc = HEADER.unpack(f.read(HEADER.size))
            words.append(np.frombuffer(f.read(2 * size), "<u2"))
            lengths.append(n)
            sums.append(crc)
            place += HEADER.size + 2 * size
        # all blocks but a file's last have the same length, so they are longest first
        for ids, crc in zip(decode_blocks(words, np.array(lengths), vocab), sums):
            if checksum(ids) != crc:
                raise ValueError(f"{path}: a block before byte {place} is damaged")
            yield ids


ROWS = "id long, start long, n_tokens long, ids_crc32 long"


def read_ids(batches, before: dict[str, int]):
    """A row per document of the files named; ``before``: ids in all earlier files."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, inner = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(inner) as f:
                f.seek(f.size() - FOOTER.size)
                vocab, place, size, crc = FOOTER.unpack(f.read(FOOTER.size))
                f.seek(place)
                data = f.read(size)
                if zlib.crc32(data) != crc:
                    raise ValueError(f"{path}: the document table is damaged")
                docs = pa.ipc.open_stream(data).read_all()
                lengths = docs.column("n").to_numpy()
                crcs, blocks, held = [], read_blocks(path, f, place, vocab), np.empty(0, np.uint32)
                for n in lengths.tolist():
                    parts, need = [], n
                    while need > len(held):
                        parts.append(held)
                        need -= len(held)
                        held = next(blocks)
                    crcs.append(checksum(np.concatenate([*parts, held[:need]])))
                    held = held[need:]
            start = before[path] + np.cumsum(lengths) - lengths
            yield pa.RecordBatch.from_arrays(
                [docs.column("id").combine_chunks(), pa.array(start), pa.array(lengths), pa.array(crcs, pa.int64())],
                ["id", "start", "n_tokens", "ids_crc32"])


def write_id_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Tokenise and write; returns path and tokens of each file, in document order by path."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.repartitionByRange(parts, "id").sortWithinPartitions("id", F.length("text"))
                 .mapInArrow(partial(write_ids, folder=scratch(spark, "ids"), tokenizer_path=tokenizer_path,
                                     end_id=end_id), "path string, tokens long"), "id-files")


def read_id_files(files: DataFrame) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    found = sorted(tuple(r) for r in files.collect())  # one row per file
    before = dict(zip((p for p, _ in found), accumulate([0] + [n for _, n in found])))
    return files.repartition(max(1, len(found)), "path").select("path") \
        .mapInArrow(partial(read_ids, before=before), ROWS)


@register("op4_context_mixing")
def op4(spark, sf_dir):
    files = write_id_files(table(spark, sf_dir, "documents"), tokenizer_file())
    return read_id_files(files).withColumnRenamed("id", "doc_id")
