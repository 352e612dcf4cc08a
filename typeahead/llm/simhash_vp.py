"""Near-duplicate documents: SimHash fingerprints joined through a sharded vantage-point tree.

* Fingerprint: XXH64 (seed 42) of every 4-word shingle, repeats included; a bit is set when
  over half of the hashes have it.  Fewer words: the whole sequence; none: zero.
* Distinct fingerprints are indexed.  The upper tree is fitted on a bounded sample (it only
  chooses vantage points and radii; every fingerprint is routed).  A node sends a
  fingerprint to the side it lies on, and, where its distance to the radius is within
  ``max_bits``, also as a visitor to the other side: by the triangle inequality no link can
  hide behind a wider gap.  Points outside visit inwards only, so a pair meets once.
* Each shard goes on with a tree of its own in memory, compares the residents of a leaf with
  its residents and visitors, and returns a spanning forest of the links (never all pairs
  of a cluster).
* Alternating large-star / small-star passes turn the forest into components.

Null or empty text: fingerprint zero, linked like any other.  A null id is never a
component's smallest id unless it has no other.  Repeated rows share their fingerprint and
each get a row.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import in_worker, keep_rows, stage, table, text_key
from .queries import register

SAMPLE = 1 << 17     # fingerprints that fit the upper tree, at most (1 MiB)
SHARD = 1 << 15      # aimed residents per shard: few shards, so few copies of boundary points
LEAF = 1 << 10       # aimed residents per leaf of a shard's own tree
CHUNK = 1 << 21      # pairs compared at a time


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    spans = zip(starts[:len(words) - k + 1].tolist(), (ends[k - 1:] - 1).tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans),
                         np.uint64, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 255 * 64):  # sums of 255 bits fit a byte
        bits = np.unpackbits(hashes[lo:lo + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


@in_worker("simhash")
def fingerprint_batches(batches, shingle: int):
    for batch in batches:
        fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64,
                          batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))],
                                         ["id", "key", "fp"])


# --- the upper tree -----------------------------------------------------------------------

def fit_tree(sample: np.ndarray, total: int, shard: int, max_bits: int, seed: int = 5):
    """Nodes (vantage, radius, left, right) as arrays; children >= 0 are nodes, < 0 shards ~i."""
    rng = np.random.default_rng(seed)
    nodes: list[list[int]] = []
    shards = 0

    def leaf() -> int:
        nonlocal shards
        shards += 1
        return -shards

    def grow(points: np.ndarray) -> int:
        if len(points) < 16 or len(points) * total <= shard * len(sample):
            return leaf()
        best = None
        for v in points[rng.choice(len(points), min(8, len(points)), replace=False)]:
            d = np.bitwise_count(points ^ v).astype(int)
            mu = int(np.median(d))
            for radius in {mu - 1, mu}:
                inside = int((d <= radius).sum())
                if 0 < inside < len(points):
                    band = int(((d > radius - max_bits) & (d <= radius + max_bits)).sum())
                    cost = band + abs(2 * inside - len(points))
                    if best is None or cost < best[0]:
                        best = (cost, band, v, radius, d <= radius)
        # a dense ball lies wholly in the band: splitting it would only copy it
        if best is None or best[1] > 0.95 * len(points):
            return leaf()
        _, _, v, radius, inner = best
        at = len(nodes)
        nodes.append([v, radius, 0, 0])
        nodes[at][2], nodes[at][3] = grow(points[inner]), grow(points[~inner])
        return at

    root = grow(sample)
    return (np.array([n[0] for n in nodes], np.uint64), [n[1:] for n in nodes], root)


def walk(fps: np.ndarray, resident: np.ndarray, tree, max_bits: int):
    """(leaf, rows, resident?) for every leaf that rows of ``fps`` live in or must visit."""
    vantage, nodes, root = tree
    todo = [(root, np.flatnonzero(resident), True), (root, np.flatnonzero(~resident), False)]
    while todo:
        at, rows, here = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            yield ~at, rows, here
            continue
        radius, inner, outer = nodes[at]
        d = np.bitwise_count(fps[rows] ^ vantage[at]).astype(np.int64)
        if here:
            todo += [(inner, rows[d <= radius], True), (outer, rows[d > radius], True),
                     (inner, rows[(d > radius) & (d <= radius + max_bits)], False)]
        else:
            todo += [(inner, rows[d <= radius + max_bits], False),
                     (outer, rows[d > radius - max_bits], False)]


def dense_leaves(sample: np.ndarray, total: int, shard: int, tree, max_bits: int) -> dict[int, int]:
    """Leaves that no split made small, by the sample: into how many blocks each is dealt."""
    found = {}
    for leaf, rows, here in walk(sample, np.ones(len(sample), bool), tree, max_bits):
        if here and len(rows) * total > 2 * shard * len(sample):
            found[leaf] = -(-len(rows) * total // (shard * len(sample)))
    return found


@in_worker("simhash")
def route(batches, tree, max_bits: int, dense: dict[int, int]):
    """A row per leaf that a fingerprint lives in or must visit; in a dense leaf, one per pair
    of blocks, so that any two of its rows meet and no task holds more than two blocks."""
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for leaf, rows, here in walk(fps, np.ones(len(fps), bool), tree, max_bits):
            n = dense.get(leaf, 1)
            block = (fps[rows] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(n)
            pairs = [(i, j) for i in range(n) for j in range(i + 1, n)] or [(0, 0)]
            for i, j in pairs:
                some = fps[rows[(block == i) | (block == j)]]
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), leaf << 32 | i << 16 | j, np.int64)),
                         pa.array(some.view(np.int64)), pa.array(np.full(len(some), here))],
                        ["shard", "fp", "resident"])


# --- inside a shard -----------------------------------------------------------------------

def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    p = parent[x]
    while True:
        q = parent[p]
        if (q == p).all():
            return p
        p = q


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; the smaller index becomes the root."""
    while len(a):
        ra, rb = roots(parent, a), roots(parent, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def link_shard(rows: pa.Table, max_bits: int) -> pa.Table:
    points = rows.column("fp").to_numpy().view(np.uint64)
    here = rows.column("resident").to_numpy()
    own = points[here]
    parent = np.arange(len(points))
    leaves: dict[int, dict[bool, list[np.ndarray]]] = {}
    if len(own):
        for leaf, at, resident in walk(points, here, fit_tree(own, len(own), LEAF, max_bits), max_bits):
            leaves.setdefault(leaf, {True: [], False: []})[resident].append(at)
    for parts in leaves.values():
        if not parts[True]:
            continue
        at = np.concatenate(parts[True] + parts[False])  # residents first
        n = sum(map(len, parts[True]))
        step = max(1, CHUNK // len(at))
        for lo in range(0, n, step):
            block = points[at[lo:min(n, lo + step)]]
            i, j = np.nonzero(np.bitwise_count(block[:, None] ^ points[at[None, lo:]]) <= max_bits)
            apart = j > i
            union(parent, at[i[apart] + lo], at[j[apart] + lo])
            parent = parent[parent]
    root = roots(parent, np.arange(len(points)))
    child = np.flatnonzero(points[root] != points)
    return pa.table({"a": points[child].view(np.int64), "b": points[root[child]].view(np.int64)})


# --- components ---------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Large-star and small-star passes: each node's larger neighbours, then its smaller ones,
    are hung on its smallest neighbour, until no edge changes.  Passes grow with the
    logarithm of the longest path; nothing is collected but two numbers per pass.
    """
    def stars(pairs: DataFrame) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")), "smallest")  # lets AQE split hot u
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        large = stage(large, "large-star")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        small = large.join(low, "u")
        return (small.select("u", "m").union(small.filter("v <> m").select("v", "m"))
                .toDF("a", "b").distinct())

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    pairs = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a <> b").distinct(), "links")
    before, seen = None, state(pairs)
    while seen != before:
        pairs = stage(stars(pairs), "links")
        before, seen = seen, state(pairs)
    return (pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(pairs.select("b", "b").distinct()))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, fp (the fingerprint as a signed long), component_id."""
    return (assign(docs, id_col, text_col, shingle, max_bits).drop("key", "root")
            .withColumnRenamed("id", id_col))


def assign(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """The rows of :func:`simhash_components`, with the text's key and the component's root."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       text_key(text_col).alias("key"))
    prints = stage(rows.mapInArrow(partial(fingerprint_batches, shingle=shingle), "id long, key long, fp long"),
                   "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("min_id")), "classes")

    total = classes.count()
    share = min(1.0, 0.9 * SAMPLE / max(1, total))
    key = F.xxhash64("fp", F.lit(11)) / F.lit(float(1 << 64)) + 0.5
    sample = np.array([r.fp for r in classes.filter(key < share).select("fp").limit(SAMPLE).collect()],
                      np.int64).view(np.uint64)
    tree = fit_tree(np.sort(sample), total, SHARD, max_bits)
    dense = dense_leaves(sample, total, SHARD, tree, max_bits) if len(sample) else {}

    def link(rows: pa.Table) -> pa.Table:
        return link_shard(rows, max_bits)

    links = (classes.select("fp")
             .mapInArrow(partial(route, tree=tree, max_bits=max_bits, dense=dense), "shard long, fp long, resident boolean")
             .groupBy("shard").applyInArrow(link, "a long, b long"))
    linked = components(links)
    named = classes.join(linked, classes["fp"] == linked["node"], "left") \
        .select("fp", "min_id", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "named")
    smallest = stage(named.groupBy("root").agg(F.min("min_id").alias("component_id")), "smallest")
    by_print = stage(named.join(smallest, "root").select("fp", "root", "component_id"), "components")
    return prints.join(by_print, "fp")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` reduced to the row with the smallest id of each component, columns unchanged."""
    first = F.min(F.struct(F.col("id").isNull(), "id", "key"))
    keep = assign(docs, id_col, text_col, shingle, max_bits).groupBy("root").agg(first.alias("first"))
    return keep_rows(docs, keep.select("first.id", "first.key"), id_col, text_col)


@register("op9_simhash_vp_tree")
def op9(spark, sf_dir):
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")
