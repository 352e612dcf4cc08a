"""Interpolated modified Kneser-Ney bigram or trigram model, counted in Spark, scored from
mapped arrays.

Tokens are white-space words, A-Z lower-cased, and an end token per text.  Training makes

* the vocabulary: token hashes in sorted arrays (a token's id is its rank), with counts;
* at order three, the trigrams: per context (two ids) the ids that follow, with counts, and
  the context's total and counts of counts.  A context lies in the shard of its second id,
  those of very frequent ids are spread over all shards by both ids;
* the bigrams: hashes of (context id, token id) in sorted arrays, with counts.  Bigrams lie in
  the shard of their context, but those of very frequent contexts are spread over all shards,
  so no shard follows a hot word.  At order three their counts are of the distinct ids that
  stand before them, and plain ones where a text starts;
* per id: one over the context's count, its back-off weight, and the Kneser-Ney unigram.

All arrays are written to the folder that executors share; workers map them into memory and
look their texts' distinct tokens and n-grams up by binary search.  N-gram hashes have twice the
bits of an id; a shard's leading bits are kept as offsets and the rest in as few bytes as hold
it, counts in a byte each with the few larger ones beside them.  Discounts are the usual
three per order, from counts of counts.  A text's first token is predicted from the start
alone, the second from the start and the first.

Null text is an empty one: the end token alone.  With no training text every probability is
one.  Rows that repeat a document count and are scored each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import id_remainder, scratch, stage, table
from .queries import register

END = xxhash.xxh64_intdigest(b" end")  # words have no blanks
VOCAB_SHARD = 500_000    # tokens per vocabulary file, about
PAIR_SHARD = 3_000_000   # training tokens per bigram file, about
ID_BLOCK = 1 << 19       # ids per file of the per-id arrays
SLICE_TOKENS = 1_000_000   # tokens that a worker holds as arrays at a time, about
LOW = np.uint64(0xFFFFFFFF)


# --- arrays in the shared folder ------------------------------------------------------------

def write_array(folder: str, name: str, values: np.ndarray) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    temp = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(np.ascontiguousarray(values).data if len(values) else b"")
    fs.move(temp, f"{root}/{name}")


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """The array mapped into memory where the store is a mounted file system, else read."""
    fs, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if fs.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.asarray(np.memmap(path, dtype, mode="r"))  # still mapped; plain arrays index faster
    return np.frombuffer(fs.open_input_file(path).readall(), dtype)


def plane_types(bits: int) -> list[np.dtype]:
    """The types that hold numbers of ``bits`` bits, low part first, in as few bytes as they need."""
    out = []
    while bits > 0:
        out.append(np.dtype(np.uint32 if bits > 24 else np.uint16 if bits > 8 else np.uint8))
        bits -= 8 * out[-1].itemsize
    return out or [np.dtype(np.uint8)]


def as_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """The bytes of numbers below ``2 ** bits``, part by part."""
    out, shift = [], 0
    for kind in plane_types(bits):
        out.append((values.astype(np.uint64) >> np.uint64(shift)).astype(kind).view(np.uint8))
        shift += 8 * kind.itemsize
    return np.concatenate(out)


class Planes:
    """Numbers written by ``as_planes``."""

    def __init__(self, data: np.ndarray, bits: int):
        kinds, self.planes, at = plane_types(bits), [], 0
        n = len(data) // sum(k.itemsize for k in kinds)
        for kind in kinds:
            self.planes.append(data[at:at + n * kind.itemsize].view(kind))
            at += n * kind.itemsize

    def __len__(self) -> int:
        return len(self.planes[0])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out, shift = self.planes[0][at].astype(np.uint64), 8 * self.planes[0].itemsize
        for plane in self.planes[1:]:
            out |= plane[at].astype(np.uint64) << np.uint64(shift)
            shift += 8 * plane.itemsize
        return out


LARGE = 255  # counts from here on lie beside the bytes


def as_counts(n: np.ndarray) -> np.ndarray:
    large = np.flatnonzero(n >= LARGE).astype(np.int64)
    head = np.concatenate([[len(large)], large, n[large]]).astype(np.int64)
    return np.concatenate([head.view(np.uint8), np.minimum(n, LARGE).astype(np.uint8)])


class Counts:
    """Counts written by ``as_counts``."""

    def __init__(self, data: np.ndarray):
        n = int(data[:8].view(np.int64)[0])
        self.places, self.large = data[8:8 + 16 * n].view(np.int64).reshape(2, n)
        self.small = data[8 + 16 * n:]

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.small[at].astype(np.int64)
        large = np.flatnonzero(out == LARGE)
        out[large] = self.large[np.searchsorted(self.places, at[large])]
        return out


def as_keys(hashed: np.ndarray, bits: int) -> np.ndarray:
    """Sorted numbers below ``2 ** bits``: where those of each leading part begin, and the rest."""
    lead = min(bits, (len(hashed) // 8).bit_length())
    rest = np.uint64(bits - lead)
    top = hashed >> rest if lead else np.zeros(len(hashed), np.uint64)
    begin = np.searchsorted(top, np.arange((1 << lead) + 1, dtype=np.uint64))
    head = np.array([lead], np.int64).view(np.uint8)
    return np.concatenate([head, begin.astype(np.uint32).view(np.uint8),
                           as_planes(hashed & np.uint64((1 << int(rest)) - 1), int(rest))])


class Keys:
    """Sorted numbers written by ``as_keys``."""

    def __init__(self, data: np.ndarray, bits: int):
        self.lead = int(data[:8].view(np.int64)[0])
        end = 8 + 4 * ((1 << self.lead) + 1)
        self.begin, self.rest = data[8:end].view(np.uint32), np.uint64(bits - self.lead)
        self.low = Planes(data[end:], int(self.rest))

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashed`` are there, and the places of those."""
        top = (hashed >> self.rest).astype(np.int64) if self.lead else np.zeros(len(hashed), np.int64)
        wanted = hashed & np.uint64((1 << int(self.rest)) - 1)
        left, end = self.begin[top].astype(np.int64), self.begin[top + 1].astype(np.int64)
        right, last = end, len(self.low) - 1
        for _ in range(int((end - left).max(initial=0)).bit_length()):  # all ranges halve in step
            middle = (left + right) // 2
            less = (left < right) & (self.low[np.minimum(middle, last)] < wanted)
            left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
        hit = np.flatnonzero(left < end)
        hit = hit[self.low[left[hit]] == wanted[hit]]
        return hit, left[hit]


# --- tokens and keys ------------------------------------------------------------------------

def token_slices(texts: list[str | None]):
    """(first text, token hashes with an end per text, tokens per text) of runs of texts."""
    hashes, counts, first, size = [], [], 0, 0
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        hashes.append(np.array([END], np.uint64))
        counts.append(len(words) + 1)
        size += len(words) + 1
        if size >= SLICE_TOKENS:
            yield first, np.concatenate(hashes), np.array(counts)
            hashes, counts, first, size = [], [], i + 1, 0
    if counts:
        yield first, np.concatenate(hashes), np.array(counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def mix_ids(keys: np.ndarray, bits: int) -> np.ndarray:
    """A one-to-one hash of two ids of ``bits`` bits, in the halves of a number, to twice as many bits."""
    half, mask = np.uint64(bits), np.uint64((1 << 2 * bits) - 1)
    x = keys >> np.uint64(32) << half | keys & LOW
    x = x ^ (x >> half)
    x = x * np.uint64(0x9E3779B97F4A7C15) & mask
    x = x ^ (x >> np.uint64(bits - bits // 10))
    x = x * np.uint64(0xBF58476D1CE4E5B9) & mask
    return x ^ (x >> half)


def id_bits(size: int) -> int:
    """Bits of an id, with those of what is no token of a vocabulary."""
    return (size + 2).bit_length()


def pair_shards(keys: np.ndarray, bits: int, heavy: np.ndarray) -> np.ndarray:
    context = keys >> np.uint64(32)
    return top_bits(np.where(np.isin(context, heavy), mix(keys), mix(context)), bits)


def top_bits(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


class Vocabulary:
    """Token hashes to ids; an unknown token is ``size``, the start context ``size + 1``."""

    def __init__(self, spec: dict):
        self.size, self.bits, self.offsets = spec["V"], spec["vocab_bits"], spec["offsets"]
        self.hashes = {s: map_array(spec["folder"], f"vocab-{s:05d}", np.uint64) for s in self.offsets}
        self.counts = {s: map_array(spec["folder"], f"counts-{s:05d}", np.int64) for s in self.offsets}
        self.heavy = np.append(self.ids(np.sort(np.array(spec["heavy"], np.uint64)))[0], self.size + 1)
        self.heavy = self.heavy.astype(np.uint64)

    def ids(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of sorted hashes."""
        ids, counts = np.full(len(wanted), self.size, np.int64), np.zeros(len(wanted), np.int64)
        shard = top_bits(wanted, self.bits)
        for s, offset in self.offsets.items():
            lo, hi = np.searchsorted(shard, [s, s + 1])
            have = self.hashes[s]
            if lo < hi and len(have):
                at = np.minimum(np.searchsorted(have, wanted[lo:hi]), len(have) - 1)
                hit = have[at] == wanted[lo:hi]
                ids[lo:hi][hit] = offset + at[hit]
                counts[lo:hi][hit] = self.counts[s][at[hit]]
        return ids, counts

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where, ids, counts = self.ranked(hashes)
        return ids[where], counts[where]

    def ranked(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's rank among the distinct ones, and their ids, rising but for unknown tokens, and counts."""
        distinct, where = np.unique(hashes, return_inverse=True)
        return where, *self.ids(distinct)

    def distinct(self, rank: np.ndarray, ids: np.ndarray, lengths: np.ndarray):
        """An order of the tokens by context and token, where in it each distinct trigram begins, and
        these trigrams' contexts and tokens; ``ids`` are those of the ranks."""
        n = len(ids)
        bits = np.uint64(id_bits(n))
        context, token = self.contexts(rank, lengths, n), rank.astype(np.uint64)
        if 3 * int(bits) <= 64:  # one number a trigram sorts faster
            key = ((context >> np.uint64(32) << bits | context & LOW) << bits) | token
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        else:
            order, first = distinct_triples(context, token)
        at = order[first]
        of = np.append(ids, [self.size, self.size + 1, self.size + 2]).astype(np.uint64)
        context, token = context[at], of[rank[at]]
        return order, first, of[context >> np.uint64(32)] << np.uint64(32) | of[context & LOW], token

    def keys(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        context[np.cumsum(lengths) - lengths] = self.size + 1
        return context.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


    def contexts(self, ids: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
        """The two ids before each, of a vocabulary of ``size``; before a text's first there is no first (``size + 2``)."""
        first, second = np.empty_like(ids), np.empty_like(ids)
        second[1:], first[2:] = ids[:-1], ids[:-2]
        starts = np.cumsum(lengths) - lengths
        second[starts] = size + 1
        first[(starts + 1)[lengths > 1]] = size + 1
        first[starts] = size + 2
        return first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)

    def triple_shards(self, context: np.ndarray, token: np.ndarray, bits: int) -> np.ndarray:
        second = context & LOW
        mixed = np.where(np.isin(second, self.heavy), mix(context), mix(second))
        at_start = context >> np.uint64(32) == self.size + 2
        return top_bits(np.where(at_start, mix(second << np.uint64(32) | token), mixed), bits)


_opened: dict[str, object] = {}


def opened(kind, spec: dict):
    """One mapped object per worker, kind and model."""
    name = f"{kind.__name__} {spec['folder']}"
    if name not in _opened:
        for old in [k for k in _opened if not k.endswith(spec["folder"])]:
            del _opened[old]
        _opened[name] = kind(spec)
    return _opened[name]


# --- counting -------------------------------------------------------------------------------

def count_tokens(batches):
    for batch in batches:
        for _, hashes, _ in token_slices(batch.column(0).to_pylist()):
            distinct, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n)], ["token", "n"])


def write_vocabulary(rows: pa.Table, folder: str) -> pa.Table:
    shard = rows.column("shard")[0].as_py()
    hashes, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(hashes)
    write_array(folder, f"vocab-{shard:05d}", hashes[order])
    write_array(folder, f"counts-{shard:05d}", n[order].astype(np.int64))
    return pa.table({"shard": [shard], "n": [len(order)]})


def packed(values: np.ndarray) -> pa.Array:
    """Bytes of equal weight lie together, so the leading zeros cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return pa.array([zstandard.ZstdCompressor(level=1).compress(planes)], pa.binary())


def unpacked(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    unpack, size = zstandard.ZstdDecompressor().decompress, np.dtype(dtype).itemsize
    return [np.ascontiguousarray(np.frombuffer(unpack(x.as_py()), np.uint8).reshape(size, -1).T).view(dtype).ravel()
            for x in column]


def by_shard(shards: np.ndarray):
    """An order that puts equal shards together, and (shard, from, to) in it."""
    order = np.argsort(shards, kind="stable")
    shards = shards[order]
    cuts = np.append(np.flatnonzero(np.diff(shards, prepend=-1)), len(shards))
    return order, [(int(shards[lo]), lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:])]


def pair_rows(keys: np.ndarray, n: np.ndarray, bits: int, heavy: np.ndarray):
    """Per shard one row: the sorted bigram keys as compressed gaps, and counts."""
    order, parts = by_shard(pair_shards(keys, bits, heavy))
    keys, n = keys[order], n[order].astype(np.uint32)
    for shard, lo, hi in parts:
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), packed(np.diff(keys[lo:hi], prepend=np.uint64(0))), packed(n[lo:hi])],
            ["shard", "keys", "n"])


def count_pairs(batches, spec: dict):
    """Per batch and shard one row of bigrams."""
    vocab = opened(Vocabulary, spec)
    for batch in batches:
        for _, hashes, lengths in token_slices(batch.column(0).to_pylist()):
            keys, n = np.unique(vocab.keys(vocab.of(hashes)[0], lengths), return_counts=True)
            yield from pair_rows(keys, n, spec["pair_bits"], vocab.heavy)


def distinct_triples(context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by context and token, and where in it each distinct trigram begins."""
    order = np.lexsort((token, context))
    context, token = context[order], token[order]
    new = np.ones(len(order), bool)
    new[1:] = (context[1:] != context[:-1]) | (token[1:] != token[:-1])
    return order, np.flatnonzero(new)


def count_triples(batches, spec: dict):
    """Per batch and shard one row of trigrams: sorted contexts as gaps, tokens and counts."""
    vocab = opened(Vocabulary, spec)
    for batch in batches:
        for _, hashes, lengths in token_slices(batch.column(0).to_pylist()):
            rank, ids, _ = vocab.ranked(hashes)
            _, first, context, token = vocab.distinct(rank, ids, lengths)
            n = np.diff(first, append=len(hashes)).astype(np.uint32)
            order, parts = by_shard(vocab.triple_shards(context, token, spec["pair_bits"]))
            context, token, n = context[order], token[order].astype(np.uint32), n[order]
            for shard, lo, hi in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), packed(np.diff(context[lo:hi], prepend=np.uint64(0))), packed(token[lo:hi]),
                     packed(n[lo:hi])], ["shard", "contexts", "tokens", "n"])


def fold_triples(rows: pa.Table, spec: dict) -> pa.Table:
    """Add up one shard's trigrams, write its arrays, and return its bigrams by the number of
    ids before them, and the counts of counts (shard -1)."""
    vocab, folder, bits = opened(Vocabulary, spec), spec["folder"], id_bits(spec["V"])
    shard = rows.column("shard")[0].as_py()
    context = np.concatenate([np.cumsum(g, dtype=np.uint64) for g in unpacked(rows.column("contexts"), np.uint64)])
    token = np.concatenate(unpacked(rows.column("tokens"), np.uint32)).astype(np.uint64)
    n = np.concatenate(unpacked(rows.column("n"), np.uint32)).astype(np.int64)
    order, first = distinct_triples(context, token)
    n = np.add.reduceat(n[order], first)
    context, token = context[order][first], token[order][first]

    at_start = context >> np.uint64(32) == vocab.size + 2
    start_keys, start_n = (context << np.uint64(32) | token)[at_start], n[at_start]
    context, token, n = context[~at_start], token[~at_start], n[~at_start]
    keys, before = np.unique(context << np.uint64(32) | token, return_counts=True)
    keys, before = np.append(keys, start_keys), np.append(before, start_n)
    order = np.argsort(keys)
    out = list(pair_rows(keys[order], before[order], spec["pair_bits"], vocab.heavy))
    of = np.array([(n == c).sum() for c in (1, 2, 3, 4)], np.int64)
    out.append(pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([b""], pa.binary()), packed(of)],
                                          ["shard", "keys", "n"]))
    starts = np.flatnonzero(np.diff(context, prepend=~context[:1]))
    degree = np.diff(starts, append=len(context))
    # a context with one id after it needs no more than that; most are such
    one = starts[degree == 1]
    hashed = mix_ids(context[one], bits)
    order = np.argsort(hashed)
    one = one[order]
    for name, values in (("ones", as_keys(hashed[order], 2 * bits)), ("onetokens", as_planes(token[one], bits)),
                         ("onecounts", as_counts(n[one]))):
        write_array(folder, f"{name}-{shard:05d}", values)
    many = np.repeat(degree > 1, degree)
    sums = [np.add.reduceat(x.astype(np.int64), starts)[degree > 1] if len(starts) else np.empty(0, np.int64)
            for x in (n == 1, n == 2, n)]
    starts, token, n = starts[degree > 1], token[many], n[many]
    begin = np.cumsum(degree[degree > 1]) - degree[degree > 1]
    hashed = mix_ids(context[starts], bits)
    order = np.argsort(hashed)
    for name, values in (("many", as_keys(hashed[order], 2 * bits)), ("manybegin", begin[order].astype(np.uint32)),
                         ("manyids", as_counts(degree[degree > 1][order])), ("manytokens", as_planes(token, bits)),
                         ("manycounts", as_counts(n)),
                         *((f"many{c}", as_counts(x[order])) for c, x in zip(("n1", "n2", "total"), sums))):
        write_array(folder, f"{name}-{shard:05d}", values)
    return pa.Table.from_batches(out)


STATS = "kind int, id long, n1 long, n2 long, n3 long, total long"


def fold_pairs(rows: pa.Table, spec: dict) -> pa.Table:
    """Add up one shard's bigrams, write its arrays, and return what its contexts (kind 0),
    tokens (1), counts of counts (2) and those of trigrams (3) contribute."""
    shard = rows.column("shard")[0].as_py()
    if shard < 0:  # counts of counts of the trigrams
        of = np.sum(unpacked(rows.column("n"), np.int64), axis=0)
        return pa.table({"kind": pa.array([3], pa.int32()), "id": [0],
                         **{c: [int(x)] for c, x in zip(("n1", "n2", "n3", "total"), of)}})
    keys = [np.cumsum(gaps, dtype=np.uint64) for gaps in unpacked(rows.column("keys"), np.uint64)]
    n = [x.astype(np.int64) for x in unpacked(rows.column("n"), np.uint32)]
    keys, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1)))
    keys, n = keys[first], np.add.reduceat(n, first)
    bits = id_bits(spec["V"])
    hashed = mix_ids(keys, bits)
    order = np.argsort(hashed)
    write_array(spec["folder"], f"pairs-{shard:05d}", as_keys(hashed[order], 2 * bits))
    write_array(spec["folder"], f"paircounts-{shard:05d}", as_counts(n[order]))

    context, token = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    starts = np.flatnonzero(np.diff(context, prepend=context[0] ^ np.uint64(1)))
    by = [np.add.reduceat(x.astype(np.int64), starts) for x in (n == 1, n == 2, n >= 3, n)]
    tokens, seen = np.unique(token, return_counts=True)
    zero = np.zeros(len(tokens), np.int64)
    of = [int((n == c).sum()) for c in (1, 2, 3, 4)]
    cols = [np.concatenate([np.zeros(len(starts), np.int32), np.ones(len(tokens), np.int32), [2]]),
            np.concatenate([context[starts].astype(np.int64), tokens.astype(np.int64), [0]])]
    cols += [np.concatenate([b, a, [o]]) for b, a, o in zip(by, (seen, zero, zero, zero), of)]
    return pa.table(dict(zip(("kind", "id", "n1", "n2", "n3", "total"),
                             [pa.array(cols[0].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in cols[1:])])))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where counts of counts are missing, halves."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def write_ids(rows: pa.Table, spec: dict) -> pa.Table:
    """The per-id arrays of one block of ids."""
    block = rows.column("block")[0].as_py()
    size = min(ID_BLOCK, spec["V"] + 2 - block * ID_BLOCK)
    at = rows.column("id").to_numpy() - block * ID_BLOCK
    n1, n2, n3, total, seen = (rows.column(c).to_numpy().astype(float) for c in ("n1", "n2", "n3", "total", "seen"))
    d, e = spec["D"], spec["E"]
    inverse, backoff, unigram = np.zeros(size, np.float32), np.ones(size, np.float32), np.zeros(size)
    context = total > 0
    inverse[at[context]] = 1 / total[context]
    backoff[at[context]] = ((d[0] * n1 + d[1] * n2 + d[2] * n3)[context] / total[context])
    cut = np.select([seen == 1, seen == 2, seen >= 3], e, 0.0)
    unigram[at] = (seen - cut) / max(1, spec["types"])
    unigram += spec["rest"]
    for name, values in (("inverse", inverse), ("backoff", backoff), ("unigram", unigram.astype(np.float32))):
        write_array(spec["folder"], f"{name}-{block:05d}", values)
    return pa.table({"block": [block]})


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> dict:
    """Count and write the model of ``docs``; returns its specification (a few numbers and
    lists that grow with the number of files, not of tokens)."""
    if order not in (2, 3):
        raise ValueError("the order is two or three")
    spark = docs.sparkSession
    folder = scratch(spark, "kneser-ney")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = stage(texts.mapInArrow(count_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")),
                   "tokens")
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if v + 3 >= 1 << 32:
        raise ValueError("a bigram key holds two 32-bit ids")
    bits = max(0, (v // VOCAB_SHARD).bit_length())
    pair_bits = max(0, (n // PAIR_SHARD).bit_length())
    top = F.shiftrightunsigned("token", 64 - bits) if bits else F.lit(0).cast("long")

    def vocabulary(rows: pa.Table) -> pa.Table:
        return write_vocabulary(rows, folder)

    sizes = dict(counts.withColumn("shard", top).groupBy("shard")
                 .applyInArrow(vocabulary, "shard long, n long").collect())
    offsets, total = {}, 0
    for s in sorted(sizes):
        offsets[s], total = total, total + sizes[s]
    # at most 4 contexts per shard can be this frequent
    limit = max(1, n >> (pair_bits + 2))
    heavy = [r.token % (1 << 64) for r in counts.filter(F.col("n") > limit).select("token").collect()]
    spec = {"folder": folder, "V": v, "N": n, "vocab_bits": bits, "pair_bits": pair_bits, "offsets": offsets,
            "heavy": heavy, "order": order, "D3": (0.5,) * 3, "D": (0.5,) * 3, "E": (0.5,) * 3, "types": 0, "rest": 1 / (v + 1)}
    if not n:
        return spec

    def fold(rows: pa.Table) -> pa.Table:
        return fold_pairs(rows, spec)

    def fold_three(rows: pa.Table) -> pa.Table:
        return fold_triples(rows, spec)

    pairs = "shard long, keys binary, n binary"
    if order == 2:
        counted = texts.mapInArrow(partial(count_pairs, spec=spec), pairs)
    else:
        counted = texts.mapInArrow(partial(count_triples, spec=spec),
                                   "shard long, contexts binary, tokens binary, n binary") \
            .groupBy("shard").applyInArrow(fold_three, pairs)
    stats = stage(counted.groupBy("shard").applyInArrow(fold, STATS), "pair-stats")
    of3 = stats.filter("kind = 3").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "total")]).first()
    of = stats.filter("kind = 2").agg(*[F.sum(c) for c in ("n1", "n2", "n3", "total")]).first()
    kind0, kind1 = F.col("kind") == 0, F.col("kind") == 1
    by_id = stage(stats.filter("kind < 2").groupBy("id").agg(
        *[F.coalesce(F.sum(F.when(kind0, F.col(c))), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "total")],
        F.coalesce(F.sum(F.when(kind1, F.col("n1"))), F.lit(0)).alias("seen")), "ids")
    seen = dict(by_id.filter("seen BETWEEN 1 AND 4").groupBy("seen").count().collect())
    types, words, one, two = by_id.agg(F.sum("seen"), F.sum((F.col("seen") > 0).cast("long")),
                                       F.sum((F.col("seen") == 1).cast("long")),
                                       F.sum((F.col("seen") == 2).cast("long"))).first()
    e = discounts(*(seen.get(k, 0) for k in (1, 2, 3, 4)))
    rest = (e[0] * one + e[1] * two + e[2] * (words - one - two)) / types / (v + 1)
    spec |= {"D3": discounts(*of3), "D": discounts(*of), "E": e, "types": types, "rest": rest}

    def blocks(rows: pa.Table) -> pa.Table:
        return write_ids(rows, spec)

    ids = by_id.union(spark.createDataFrame([(v, 0, 0, 0, 0, 0)], by_id.schema))  # the unknown token
    ids.withColumn("block", F.floor(F.col("id") / ID_BLOCK)).groupBy("block") \
        .applyInArrow(blocks, "block long").count()
    return spec


# --- scoring --------------------------------------------------------------------------------

TRIPLES = ("ones", "onetokens", "onecounts", "many", "manybegin", "manyids", "manytokens", "manycounts", "manyn1",
           "manyn2", "manytotal")


def map_packed(folder: str, name: str, shard: int, bits: int):
    data = map_array(folder, f"{name}-{shard:05d}", np.uint32 if name == "manybegin" else np.uint8)
    if name in ("ones", "many", "pairs"):
        return Keys(data, 2 * bits)
    return data if name == "manybegin" else Planes(data, bits) if name.endswith("tokens") else Counts(data)


class Model(Vocabulary):
    def __init__(self, spec: dict):
        super().__init__(spec)
        self.spec = spec
        shards = range(1 << spec["pair_bits"]) if spec["N"] else ()
        folder = spec["folder"]
        fs, root = pafs.FileSystem.from_uri(folder)
        there = {f.base_name for f in fs.get_file_info(pafs.FileSelector(root))} if spec["N"] else set()
        self.id_bits = id_bits(self.size)
        self.pairs = {s: tuple(map_packed(folder, name, s, self.id_bits) for name in ("pairs", "paircounts"))
                      for s in shards if f"pairs-{s:05d}" in there}
        self.triples = {s: {name: map_packed(folder, name, s, self.id_bits) for name in TRIPLES}
                        for s in shards if f"ones-{s:05d}" in there}
        n_blocks = -(-(self.size + 2) // ID_BLOCK)
        self.by_id = {name: [map_array(folder, f"{name}-{b:05d}", np.float32) if f"{name}-{b:05d}" in there
                             else None for b in range(n_blocks)]
                      for name in ("inverse", "backoff", "unigram")}

    def values(self, name: str, ids: np.ndarray) -> np.ndarray:
        default = {"inverse": 0.0, "backoff": 1.0, "unigram": self.spec["rest"]}[name]
        out = np.full(len(ids), default)
        block = ids // ID_BLOCK
        for b, values in enumerate(self.by_id[name]):
            at = np.flatnonzero(block == b)
            if values is not None and len(at):
                out[at] = values[ids[at] - b * ID_BLOCK]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        shard, hashed = pair_shards(keys, self.spec["pair_bits"], self.heavy), mix_ids(keys, self.id_bits)
        order = np.lexsort((hashed, shard))
        out, shard, hashed = np.zeros(len(keys)), shard[order], hashed[order]
        for s, (have, counts) in self.pairs.items():
            lo, hi = np.searchsorted(shard, [s, s + 1])
            if lo < hi:
                hit, at = have.find(hashed[lo:hi])
                out[order[lo:hi][hit]] = counts[at]
        return out

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Each bigram's probability."""
        context, token = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        count = self.pair_counts(keys)
        cut = np.array((0.0, *self.spec["D"]))[np.minimum(count, 3).astype(np.int64)]
        return (count - cut) * self.values("inverse", context) \
            + self.values("backoff", context) * self.values("unigram", token)

    def trigram_probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Each trigram's probability; an unseen context gives the bigram's."""
        d = np.array((0.0, *self.spec["D3"]))
        second = context << np.uint64(32) | token
        keys, where = np.unique(second, return_inverse=True)
        lower = self.probability(keys)[where]
        shard, hashed = self.triple_shards(context, token, self.spec["pair_bits"]), mix_ids(context, self.id_bits)
        order = np.lexsort((hashed, shard))
        cuts = shard[order]
        for s, have in self.triples.items():
            lo, hi = np.searchsorted(cuts, [s, s + 1])
            at = order[lo:hi]
            hit, found = have["ones"].find(hashed[at])
            if len(hit):
                to = at[hit]
                total = have["onecounts"][found]
                cut = d[np.minimum(total, 3)]
                same = have["onetokens"][found] == token[to]
                lower[to] = same * (total - cut) / total + cut / total * lower[to]
            hit, found = have["many"].find(hashed[at])
            if len(hit):
                to = at[hit]
                begin, ids = have["manybegin"][found].astype(np.int64), have["manyids"][found]
                n1, n2, total = (have[c][found] for c in ("manyn1", "manyn2", "manytotal"))
                left, right, wanted = begin.copy(), begin + ids, token[to]
                for _ in range(int(ids.max(initial=0)).bit_length()):  # all ranges halve in step
                    middle = (left + right) // 2
                    less = (left < right) & (have["manytokens"][np.minimum(middle, begin + ids - 1)] < wanted)
                    left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
                place = np.minimum(left, begin + ids - 1)
                count = have["manycounts"][place] * (have["manytokens"][place] == wanted).astype(np.int64)
                back = (d[1] * n1 + d[2] * n2 + d[3] * (ids - n1 - n2)) / total
                lower[to] = (count - d[np.minimum(count, 3)]) / total + back * lower[to]
        return lower

    def scores(self, rank: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; ``ids`` are those of the tokens' ranks."""
        if self.spec["order"] == 2:
            keys, where = np.unique(self.keys(ids[rank], lengths), return_inverse=True)
            return np.log10(self.probability(keys))[where]
        order, first, context, token = self.distinct(rank, ids, lengths)
        out = np.empty(len(rank))
        out[order] = np.repeat(np.log10(self.trigram_probability(context, token)), np.diff(first, append=len(rank)))
        return out


SCORES = ("id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def score_batches(batches, spec: dict):
    model = opened(Model, spec)
    names = [f.split()[0] for f in SCORES.split(", ")]
    for batch in batches:
        for first, hashes, lengths in token_slices(batch.column(2).to_pylist()):
            rank, ids, counts = model.ranked(hashes)
            counts = counts[rank]
            starts = np.cumsum(lengths) - lengths
            score = np.add.reduceat(model.scores(rank, ids, lengths), starts)
            base = np.add.reduceat(np.log10((counts + 1) / (spec["N"] + spec["V"] + 1)), starts)
            known = np.add.reduceat((counts > 0).astype(np.int64), starts)
            rows = batch.slice(first, len(lengths))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(lengths.astype(np.int64)), pa.array(known),
                 pa.array(np.full(len(lengths), spec["N"])), pa.array(base), pa.array(score)], names)


def perplexity_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
                      order: int = 2) -> DataFrame:
    """Train on the rows where ``held_out`` (a boolean column) is false; score all rows."""
    spec = train(docs.filter(~held_out), text_col, order)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(score_batches, spec=spec), SCORES).withColumnRenamed("id", id_col)


@register("op8_kneser_ney")
def op8(spark, sf_dir):
    return perplexity_scores(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 7) == 2, order=3)
