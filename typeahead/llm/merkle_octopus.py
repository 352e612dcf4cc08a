"""Merkle manifest of a table, with octopus multiproofs per leaf partition.

Each row is a leaf: SHA-256 over its columns, each ``-`` if null, else its UTF-8 byte count,
``:`` and its value.  The leaves of a group (a source), in id order, are the lowest level of
the group's tree; every ``arity`` consecutive nodes become their parent, the last run of a
level may be shorter.  The groups' roots, in group order (null first, then bytewise), are the
leaves of the top tree.

Positions come from one range partitioning by (group, id): run lengths per partition, summed
per group.  Trees are folded in aligned blocks of ``arity ** STEP`` nodes, so a hot group is
as many tasks as it has blocks.  A leaf partition then works out the nodes it lacks to rebuild
every path of its leaves (at most ``2 * (arity - 1)`` a level and tree, whatever the number of
its leaves), fetches those once, derives all interior nodes that its leaves share, and writes
out each leaf's own proof.

Rows that repeat an id are ordered by leaf digest; wholly equal rows are leaves of their own.
A null id sorts first and its decimal form is empty.  An empty table has no root and no rows;
columns not named are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import id_remainder, stage, table
from .queries import register

STEP = 8            # levels folded in one block: 3^8 nodes
PART_LEAVES = 20_000
TOP = -1            # the tree over the groups' roots
NODE = "tree long, level int, idx long, width long, hash binary"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def parent(run: list[bytes]) -> bytes:
    """The digest of a run of nodes, whose digests are concatenated as hex text."""
    return sha(b"".join(run).hex().encode())


def field(col: Column) -> Column:
    text = col.cast("string")
    return F.when(col.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(cols: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in cols]).cast("binary"), 256))


class Manifest(NamedTuple):
    leaves: DataFrame  # part, tree, pos, n, id, leaf, changed (digest to verify, null: as leaf)
    nodes: DataFrame   # tree, level, idx, width, hash: all nodes above the leaves
    roots: DataFrame   # tree, hash: each group's root
    root: bytes | None
    arity: int


def fold_blocks(batches, arity: int, step: int):
    """All nodes up to ``step`` levels above each aligned block of sorted (tree, idx) nodes."""
    span = arity ** step

    def fold(key, width: int, row: list[bytes]):
        tree, block, level = key
        lo = block * span
        while width > 1 and level < key[2] + step:
            row = [parent(row[i:i + arity]) for i in range(0, len(row), arity)]
            lo, width, level = lo // arity, -(-width // arity), level + 1
            yield from ((tree, level, lo + i, width, h) for i, h in enumerate(row))

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          ["tree", "level", "idx", "width", "hash"])

    key, n, row, out = None, 0, [], []
    for batch in batches:
        for tree, level, idx, width, h in zip(*(batch.column(c).to_pylist()
                                                for c in ("tree", "level", "idx", "width", "hash"))):
            if key != (tree, idx // span, level):
                if row:
                    out += fold(key, n, row)
                key, n, row = (tree, idx // span, level), width, []
                if len(out) > 10_000:
                    yield table_of(out)
                    out = []
            row.append(h)
    if row:
        out += fold(key, n, row)
    yield table_of(out)


def fold_trees(level: DataFrame, widest: int, arity: int, label: str) -> DataFrame | None:
    """The nodes above ``level`` (rows of NODE); None where no tree has more than one leaf."""
    found, span, base = None, arity ** STEP, 0
    while widest > 1:
        block = F.expr(f"idx div {span}")
        made = stage(level.filter("width > 1").repartition("tree", block).sortWithinPartitions("tree", "idx")
                     .mapInArrow(partial(fold_blocks, arity=arity, step=STEP), NODE), label)
        found = made if found is None else found.unionByName(made)
        base, widest = base + STEP, -(-widest // span)
        level = made.filter(F.col("level") == base)
    return found


def build_manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
                   group_col: str = "source", changed: Column | None = None, arity: int = 3) -> Manifest:
    """``changed``: per row the digest found on verification, null where the row is as written."""
    spark = rows.sparkSession
    group = F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    narrow = stage(rows.select(F.col(id_col).alias("id"), group.alias("grp"),
                               digest([F.col(c) for c in fields]).alias("leaf"),
                               (F.lit(None).cast("binary") if changed is None else changed).alias("changed"),
                               F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    parts = max(1, narrow.count() // PART_LEAVES)
    order = ["grp", "id", "leaf", "tie"]  # tie spreads wholly equal rows over partitions
    placed = stage(narrow.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()),
                   "merkle-parts")

    # one row per (partition, group): where the run starts in its group
    runs = stage(placed.groupBy("part", "grp").agg(F.count("*").alias("rows")), "merkle-runs")
    groups = stage(runs.groupBy("grp").agg(F.min("part").alias("first"), F.sum("rows").alias("n")), "merkle-groups")
    new = {r[0]: r[1] for r in groups.groupBy("first").count().collect()}  # a row per partition
    before, n_groups = [], 0
    for p in sorted(new):
        before.append((p, n_groups))
        n_groups += new[p]
    rank = F.row_number().over(Window.partitionBy("first").orderBy("grp"))
    trees = (groups.withColumn("rank", rank).join(spark.createDataFrame(before, "first int, base long"), "first")
             .select("grp", "n", (F.col("base") + F.col("rank") - 1).alias("tree")))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(runs.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
                   .join(trees, "grp").select("part", "grp", "start", "n", "tree"), "merkle-starts")
    inside = Window.partitionBy("part", "grp").orderBy("id", "leaf", "tie")
    leaves = stage(placed.withColumn("r", F.row_number().over(inside)).join(starts, ["part", "grp"])
                   .select("part", "tree", (F.col("start") + F.col("r") - 1).alias("pos"), "n", "id", "leaf", "changed"),
                   "merkle-placed")

    lowest = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"),
                           F.col("n").alias("width"), F.col("leaf").alias("hash"))
    widest = groups.agg(F.max("n")).first()[0] or 0
    inner = fold_trees(lowest, widest, arity, "merkle-nodes")
    tops = lowest.filter("width = 1")
    if inner is not None:
        tops = tops.unionByName(inner.filter("width = 1"))
    roots = stage(tops.select("tree", "hash"), "merkle-roots")
    top_row = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"),
                           F.col("tree").alias("idx"), F.lit(n_groups).cast("long").alias("width"), "hash")
    over = fold_trees(top_row, n_groups, arity, "merkle-top")
    nodes = [x for x in (inner, over) if x is not None] or [spark.createDataFrame([], NODE)]
    last = (over if over is not None else top_row).filter("width = 1").first()
    return Manifest(leaves, nodes[0] if len(nodes) == 1 else nodes[0].unionByName(nodes[1]), roots,
                    bytes(last["hash"]) if last else None, arity)


def octopus(lo: int, hi: int, width: int, arity: int):
    """(level, idx) of the nodes that someone who has nodes ``lo`` to ``hi`` of the lowest
    level lacks for all their paths; at every level the derived nodes are ``lo`` to ``hi``."""
    level = 0
    while width > 1:
        for i in range(lo - lo % arity, lo):
            yield level, i
        for i in range(hi + 1, min(hi - hi % arity + arity, width)):
            yield level, i
        lo, hi, width, level = lo // arity, hi // arity, -(-width // arity), level + 1


def missing_nodes(batches, arity: int):
    for batch in batches:
        rows = [(part, tree, level, i)
                for part, tree, lo, hi, n in zip(*(c.to_pylist() for c in batch.columns))
                for level, i in octopus(lo, hi, n, arity)]
        cols = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["part", "tree", "level", "idx"])


class Paths:
    """The part of one tree that a partition rebuilds: its leaves, the fetched nodes and
    everything derived from both."""

    def __init__(self, lo: int, row: list[bytes], width: int, fetched: dict, tree: int, arity: int):
        self.arity, self.levels, level = arity, [], 0
        while width > 1:
            hi = lo + len(row) - 1
            left = [fetched[tree, level, i] for i in range(lo - lo % arity, lo)]
            right = [fetched[tree, level, i] for i in range(hi + 1, min(hi - hi % arity + arity, width))]
            row, lo = left + row + right, lo - lo % arity
            self.levels.append((lo, row))
            row = [parent(row[i:i + arity]) for i in range(0, len(row), arity)]
            lo, width, level = lo // arity, -(-width // arity), level + 1
        self.root = row[0]
        # siblings from a node's level to the root, shared by all leaves below the node
        self.above: dict[int, list[bytes]] = {len(self.levels): [b""]}
        for level in range(len(self.levels) - 1, 0, -1):
            lo, row = self.levels[level]
            up = self.above[level + 1]
            # this level's runs begin at a run's start: node i's run is number i // arity here
            shift = lo // arity - (self.levels[level + 1][0] if level + 1 < len(self.levels) else 0)
            self.above[level] = [self._others(level, i) + up[i // arity + shift] for i in range(len(row))]

    def _others(self, level: int, i: int) -> bytes:
        row, at = self.levels[level][1], i - i % self.arity
        run = row[at:at + self.arity]
        return b"".join(h for j, h in enumerate(run) if at + j != i)

    def proof(self, idx: int) -> bytes:
        """All siblings of leaf ``idx``, level by level, left to right."""
        if not self.levels:
            return b""
        lo = self.levels[0][0]
        up = idx // self.arity - (self.levels[1][0] if len(self.levels) > 1 else 0)
        return self._others(0, idx - lo) + self.above[1][up]

    def fold(self, idx: int, digest_: bytes) -> bytes:
        """The root that ``digest_`` in place of leaf ``idx`` gives with the original siblings."""
        for lo, row in self.levels:
            i = idx - lo
            at = i - i % self.arity
            run = row[at:at + self.arity]
            run[i - at] = digest_
            digest_, idx = parent(run), idx // self.arity
        return digest_


PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def expand_proofs(leaves: pa.Table, fetched: pa.Table, root: bytes, n_groups: int, arity: int) -> pa.Table:
    have = {(t, level, i): h for t, level, i, h in zip(*(fetched.column(c).to_pylist()
                                                         for c in ("tree", "level", "idx", "hash")))}
    leaves = leaves.sort_by([("tree", "ascending"), ("pos", "ascending")])
    cols = [leaves.column(c).to_pylist() for c in ("tree", "pos", "n", "id", "leaf", "changed")]
    spans, tree = [], cols[0]
    for i in range(len(tree)):
        if not spans or tree[spans[-1][0]] != tree[i]:
            spans.append([i, i])
        spans[-1][1] = i + 1
    paths = [Paths(cols[1][a], cols[4][a:b], cols[2][a], have, tree[a], arity) for a, b in spans]
    top = Paths(tree[0], [p.root for p in paths], n_groups, have, TOP, arity) if spans else None
    out = []
    for (a, b), own in zip(spans, paths):
        subroot, rest = own.root.hex(), top.proof(tree[a])
        for i in range(a, b):
            pos, leaf, changed = cols[1][i], cols[4][i], cols[5][i]
            proof = own.proof(pos) + rest
            folded = top.fold(tree[a], own.fold(pos, leaf if changed is None else changed))
            out.append((cols[3][i], leaf.hex(), subroot, root.hex(), sha(proof.hex().encode()).hex(),
                        folded.hex(), folded == root))
    names = [c.split()[0] for c in PROOFS.split(", ")]
    kinds = [pa.int64()] + [pa.string()] * 5 + [pa.bool_()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names)


def multiproofs(manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """Per leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves, root, arity = manifest.leaves, manifest.root, manifest.arity
    spark = leaves.sparkSession
    if root is None:
        return spark.createDataFrame([], PROOFS).withColumnRenamed("id", id_col)
    n_groups = manifest.roots.count()
    own = leaves.groupBy("part", "tree").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("n").alias("n"))
    top = leaves.groupBy("part").agg(F.lit(TOP).cast("long").alias("tree"), F.min("tree").alias("lo"),
                                     F.max("tree").alias("hi"), F.lit(n_groups).cast("long").alias("n"))
    wanted = stage(own.unionByName(top).mapInArrow(partial(missing_nodes, arity=arity),
                                                   "part int, tree long, level int, idx long"), "merkle-wanted")
    lowest = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash"))
    subroots = manifest.roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"),
                                     F.col("tree").alias("idx"), "hash")
    known = manifest.nodes.select("tree", "level", "idx", "hash").unionByName(lowest).unionByName(subroots)
    fetched = stage(known.join(wanted, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "hash"),
                    "merkle-fetched")

    def expand(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return expand_proofs(mine, theirs, root, n_groups, arity)

    rows = leaves.withColumn("id", F.col("id").cast("long"))
    return (rows.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expand, PROOFS)
            .withColumnRenamed("id", id_col))


def without_newlines(rows: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
                     text_col: str = "text") -> Column:
    """The leaf digest of a row whose text lost its newlines; null where nothing changes."""
    cols = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text_col else F.col(c) for c in fields]
    hit = (id_remainder(F.col(id_col), 2) == 0) & F.contains(F.col(text_col), F.lit("\n"))
    return F.when(hit, digest(cols))


@register("op13_merkle_octopus", r"""
WITH RECURSIVE crc_table AS (  -- CRC-32 of one byte, eight shifts
  SELECT 0 AS k, b, CAST(b AS BIGINT) AS c FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT k + 1, b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END
  FROM crc_table WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM crc_table WHERE k = 8),
d AS (SELECT doc_id, source, lang, n_chars, text,
        list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                    lambda c, b: xor(t[xor(c & 255, b) + 1], c // 256)) AS crc FROM documents, tab),
e AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
        CASE WHEN (crc & 1) = 1 THEN replace(text, chr(10), '') ELSE text END AS bad FROM d),
leaf AS (SELECT doc_id, coalesce('1' || source, '0') AS grp,
           sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(bad) || ':' || bad, '-')) AS bad FROM e),
pos AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY grp) AS n FROM leaf),
tree AS (SELECT grp, 0 AS l, p AS i, n, leaf AS h FROM pos
  UNION ALL SELECT grp, l + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM tree WHERE n > 1 GROUP BY grp, l, i // 3),
sub AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS s, count(*) OVER () AS m, l AS height FROM tree WHERE n = 1),
top AS (SELECT 0 AS l, s AS i, m AS n, h FROM sub
  UNION ALL SELECT l + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY l, i // 3),
root AS (SELECT h FROM top WHERE n = 1),
sib AS (SELECT a.grp, a.l, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft,
          coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
        FROM tree a JOIN tree b ON a.grp = b.grp AND a.l = b.l AND a.i // 3 = b.i // 3 GROUP BY ALL),
topsib AS (SELECT a.l, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft,
          coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
        FROM top a JOIN top b ON a.l = b.l AND a.i // 3 = b.i // 3 GROUP BY ALL),
walk AS (SELECT doc_id, grp, 0 AS l, p AS i, n, CAST('' AS VARCHAR) AS proof, bad AS h FROM pos
  UNION ALL SELECT w.doc_id, w.grp, w.l + 1, w.i // 3, (w.n + 2) // 3, w.proof || lft || rgt, sha256(lft || w.h || rgt)
  FROM walk w JOIN sib USING (grp, l, i) WHERE w.n > 1),
up AS (SELECT doc_id, 0 AS l, s AS i, m AS n, proof, w.h FROM walk w JOIN sub USING (grp) WHERE w.n = 1
  UNION ALL SELECT u.doc_id, u.l + 1, u.i // 3, (u.n + 2) // 3, u.proof || lft || rgt, sha256(lft || u.h || rgt)
  FROM up u JOIN topsib USING (l, i) WHERE u.n > 1)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(up.proof) AS proof_sha256, up.h AS folded_root, up.h = root.h AS verified
FROM pos JOIN sub USING (grp) JOIN up USING (doc_id), root WHERE up.n = 1""")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return multiproofs(build_manifest(docs, changed=without_newlines(docs)))
