"""Dense vectors: embedding column, exact k-NN, LSH join, vector functions.

Exact nearest neighbours meet cells, not all pool rows.  Pool rows go to the nearest of some
centres, fitted on a bounded sample; a cell's radius bounds how near (or how large a dot
product) its rows can come to a probe.  A probe first visits the cells nearest to it until
they hold k rows, which gives its running k-th score; a task holds one bounded block of pool
rows and streams these probes past it in NumPy.  Then neighbouring probes form groups, a task
holds a group with its running k-th scores and streams past it the cells whose bound some
score in the group does not exclude: a pool row is shipped once per group, a probe once, and
a pair leaves the task only if it still beats the probe's running score.

A row whose vector is null or holds a null is no item, and as a probe has no neighbours, nor
is a row without a key an item; all vectors have one length; ties go to the smaller key; repeated keys are rows of their own; an empty side gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import add_char_ngrams, md5_int
from ..session import cut
from .topk import topk_per_key

EMBED_DIM = 64


def embed_text(df: DataFrame, col: str, out: str = "embedding", dim: int = EMBED_DIM) -> DataFrame:
    """D1 built-in producer: char-trigram counts hashed into ``dim`` md5
    buckets, L2-normalised (all zeros for empty text).  A learned encoder
    plugs in by producing the same ``ARRAY<FLOAT>`` column instead."""
    df = add_char_ngrams(df, col, "__g", 3)
    buckets = F.transform("__g", lambda g: (md5_int(g) % dim).cast("int"))
    # one pass over the buckets, adding 1 at each bucket's slot
    zero = F.array_repeat(F.lit(0.0), dim)
    counts = F.aggregate(buckets, zero, lambda acc, b: F.transform(
        acc, lambda v, i: F.when(i == b, v + 1.0).otherwise(v)))
    df = df.withColumn("__c", counts)
    norm = F.sqrt(F.aggregate("__c", F.lit(0.0), lambda acc, x: acc + x * x))
    df = df.withColumn("__n", norm)
    vec = F.transform("__c", lambda x: F.when(F.col("__n") > 0, x / F.col("__n")).otherwise(F.lit(0.0)).cast("float"))
    return df.withColumn(out, vec).drop("__g", "__c", "__n")


def model_encoder(load, batch_size: int = 64):
    """D1 with a learned model, as the ``encode`` argument of the tracks.

    ``load()`` runs once per Python worker and returns a function from an array of strings to
    a matrix of vectors, which gets at most ``batch_size`` texts at a time.  Null is ''."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType
    predict = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch_size)

    def encode(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.withColumn(out, predict(F.coalesce(F.col(col), F.lit(""))))
    return encode


def _d(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    a, b = (F.col(a) if isinstance(a, str) else a), (F.col(b) if isinstance(b, str) else b)
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def sq_l2(a, b) -> Column:
    a, b = (F.col(a) if isinstance(a, str) else a), (F.col(b) if isinstance(b, str) else b)
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def pair_l2_distance(a, b) -> Column:
    """Plain (not squared) L2 distance."""
    return F.sqrt(sq_l2(a, b))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a, b) -> Column:
    """Cosine in double precision; 0 when either norm is 0."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def scale_l2(a, factor: float, eps: float = 1e-10) -> Column:
    """``a / (‖a‖ + eps) · factor`` (D8's dense half)."""
    a = F.col(a) if isinstance(a, str) else a
    n = norm(a)
    return F.transform(_d(a), lambda x: x / (n + eps) * factor)


# ------------------------------------------------------------------ exact k-NN

SAMPLE_ROWS = 20_000   # pool rows, about, that the centres are fitted on
MAX_CENTRES = 1024
CELL_ROWS = 4096       # pool rows per cell, about, until MAX_CENTRES is reached
BLOCK_ROWS = 32_768    # most pool rows a task holds: larger cells are cut by a hash of the row
GROUP_ROWS = 32_768    # most probes, about, that a task holds while cells stream past them
GROUP_BLOCK = 8192     # pool rows, about, that such a task scores at once
VISITS = 200_000       # visitors of one block, about, before it is dealt to a further task


def _array(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _fit_centres(x: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """``n`` centres by Lloyd's rounds from evenly spread rows (fewer where rows repeat)."""
    c = np.unique(x[np.linspace(0, len(x) - 1, n).astype(int)], axis=0)
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


@dataclass
class Cells:
    """What is known of the pool's cells; bounded by MAX_CENTRES."""
    centres: np.ndarray
    rows: np.ndarray    # pool rows in each cell
    radius: np.ndarray  # largest distance of a row from the centre
    bias: np.ndarray    # largest bias of a row
    metric: str

    def bounds(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per probe and cell the best cost any of its rows can have, and the order in which to
        visit first; costs are squared distances or negative dot products."""
        dots, p2 = p @ self.centres.T, (p * p).sum(1)[:, None]
        dist = np.sqrt(np.maximum(p2 + (self.centres ** 2).sum(1)[None] - 2 * dots, 0))
        if self.metric == "l2":
            best = np.maximum(dist - self.radius[None], 0) ** 2
            return best - 1e-5 * (1 + best), dist
        best = -(dots + np.sqrt(p2) * self.radius[None] + self.bias[None])
        return best - 1e-5 * (1 + np.abs(best)), best

    def only(self, cell: int) -> Cells:
        at = slice(cell, cell + 1)
        return Cells(self.centres[at], self.rows[at], self.radius[at], self.bias[at], self.metric)

    def first(self, order: np.ndarray, k: int) -> np.ndarray:
        """The cells each probe visits first: in order, until they hold k rows."""
        at = np.argsort(np.where(self.rows[None] > 0, order, np.inf), axis=1, kind="stable")
        held = np.cumsum(self.rows[at], axis=1) - self.rows[at]
        chosen = np.zeros(order.shape, bool)
        np.put_along_axis(chosen, at, held < k, axis=1)
        return chosen & (self.rows[None] > 0)


def _assign(batches, centres: np.ndarray):
    for batch in batches:
        x = _array(batch.column("vec"))
        d = np.maximum((x * x).sum(1)[:, None] + (centres ** 2).sum(1)[None] - 2 * x @ centres.T, 0)
        near = d.argmin(1)
        own = np.sqrt(((x - centres[near]) ** 2).sum(1))
        yield batch.append_column("cell", pa.array(near, pa.int32())).append_column("dist", pa.array(own, pa.float64()))


def _visit(batches, cells: Cells, k: int):
    """A probe row per cell to visit first: the nearest cells."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            rows, cell = np.nonzero(cells.first(cells.bounds(_array(part.column("vec")))[1], k))
            if len(rows):
                out = part.select(["pk", "vec"]).take(pa.array(rows))
                yield out.append_column("cell", pa.array(cell, pa.int32()))


def _costs(column, k: int) -> np.ndarray:
    """The k smallest costs each probe has found, in order; infinite where fewer."""
    lists = column.to_pylist()
    out = np.full((len(lists), k), np.inf)
    for row, found in zip(out, lists):
        if found:
            row[:len(found)] = found
    return out


def _needed(batches, cells: Cells, k: int):
    """The (group, cell) pairs in which a probe of the group needs a cell that it has not
    visited: its bound is not above ``theta``, the cost of the k-th row found (null: fewer)."""
    for batch in batches:
        pairs = set()
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            best, order = cells.bounds(_array(part.column("vec")))
            theta = part.column("theta").to_numpy(zero_copy_only=False).astype(np.float64)
            theta = np.where(np.isnan(theta), np.inf, theta)
            rows, cell = np.nonzero(~cells.first(order, k) & (cells.rows[None] > 0) & (best <= theta[:, None]))
            group = part.column("group").to_numpy()[rows]
            pairs |= set(zip(group.tolist(), cell.tolist()))
        g, c = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(c, pa.int32())], ["group", "cell"])


def _distances(p: np.ndarray, x: np.ndarray, rows: np.ndarray, items: np.ndarray, step: int = 1024) -> np.ndarray:
    """Squared distances of the pairs named, few at a time so that they stay in the cache."""
    out, held = np.empty(len(rows)), np.empty((2, min(step, len(rows)), x.shape[1]))
    for a in range(0, len(rows), step):
        n = min(step, len(rows) - a)
        diff = np.take(p, rows[a:a + n], axis=0, out=held[0, :n], mode="clip")  # clip: written in place
        diff -= np.take(x, items[a:a + n], axis=0, out=held[1, :n], mode="clip")
        diff *= diff
        diff.sum(1, out=out[a:a + n])
    return out


class _Block:
    """Pool rows of one task, and the best of them for batches of probes.

    Candidates are selected in float32 (half the memory and BLAS time of float64) with a
    slack that covers float32 error; the kept pairs are then scored exactly in float64 and
    cut to k per probe by rounded score and key."""

    def __init__(self, keys: list, x: np.ndarray, bias: np.ndarray, metric: str, k: int):
        self.keys, self.x, self.bias, self.metric = np.array(keys, dtype=object), x, bias, metric
        self.x2, self.k = (x * x).sum(1), min(k, len(x))
        # with a 1 after the probe's vector one product gives a distance but for the probe's own square
        self.x32 = (np.column_stack([-2 * x, self.x2]) if metric == "l2" else x).astype(np.float32)
        self.held = np.empty((0, len(x)), np.float32)
        self.key_rank = np.empty(len(x), dtype=np.int64)
        self.key_rank[sorted(range(len(x)), key=lambda i: (keys[i] is not None, keys[i]))] = np.arange(len(x))

    def _near(self, p: np.ndarray, limit: np.ndarray | None) -> np.ndarray:
        """Which pairs may be among the k best or, with ``limit``, not above it."""
        p2 = (p * p).sum(1)
        if self.metric == "l2":
            if len(self.held) < len(p):  # written anew by every batch of probes
                self.held = np.empty((len(p), len(self.x)), np.float32)
            probes = np.column_stack([p, np.ones(len(p))]).astype(np.float32)
            s, own = np.matmul(probes, self.x32.T, out=self.held[:len(p)]), p2
            scale = p2 + self.x2.max()
        else:
            s = -((p.astype(np.float32) @ self.x32.T).astype(np.float64) + self.bias[None, :])
            own, scale = 0.0, np.sqrt(p2) * np.sqrt(self.x2.max())
        thr = limit - own if limit is not None else np.partition(s, self.k - 1, axis=1)[:, self.k - 1]
        # float32 error is a few 1e-7 of the magnitudes involved; keep a
        # wide margin plus the rounding step of the final scores
        thr = thr + 1e-5 * (1.0 + scale) + 1e-6
        return ~(s > thr[:, None].astype(s.dtype))  # what overflows is scored

    def best(self, p: np.ndarray, rescore: int = 1 << 18, limit: np.ndarray | None = None):
        """(probe row, pool row, score) of the k best per probe; with ``limit``, of those
        whose cost is not above the probe's."""
        near = self._near(p, limit)
        # many pool rows may tie: a few probes at a time, each cut to its k best
        step = max(1, rescore // max(1, int(np.count_nonzero(near, axis=1).max())))
        for a in range(0, len(p), step):
            rows, items = np.divmod(np.flatnonzero(near[a:a + step]), len(self.x))
            rows += a
            if self.metric == "l2":
                val = _distances(p, self.x, rows, items)
            else:
                val = np.einsum("ij,ij->i", p[rows], self.x[items]) + self.bias[items]
            val = np.round(val, 6) + 0.0
            order = np.lexsort((self.key_rank[items], val if self.metric == "l2" else -val, rows))
            rows, items, val = rows[order], items[order], val[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
            yield rows[keep], items[keep], val[keep]


def _score_blocks(batches, metric: str, k: int, kinds: list, chunk: int, names=("cell", "part", "deal")):
    """Rows sorted by a block's ``names`` and probe: a block's pool rows, then its visitors."""
    key, held, block = None, [], None
    for batch in batches:
        marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*names, "probe")]
        cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in marks], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            rows = batch.slice(lo, hi - lo)
            at = tuple(int(x[lo]) for x in marks[:-1])
            if at != key:
                key, held, block = at, [], None
            if not marks[-1][lo]:
                held.append(rows)
                continue
            if not held and block is None:
                continue
            if block is None:
                pool = pa.Table.from_batches(held)
                block = _Block(pool.column("ik").to_pylist(), _array(pool.column("vec").combine_chunks()),
                               pool.column("bias").to_numpy().astype(np.float64), metric, k)
                held = []
            for a in range(0, rows.num_rows, chunk):
                probes = rows.slice(a, chunk)
                asked = np.array(probes.column("pk").to_pylist(), dtype=object)
                for r, i, val in block.best(_array(probes.column("vec"))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked[r].tolist(), kinds[0]), pa.array(block.keys[i].tolist(), kinds[1]),
                         pa.array(val, pa.float64())], ["pk", "ik", "score"])


class _Group:
    """The probes of one task with the costs of their k best rows so far."""

    def __init__(self, rows: pa.Table, cells: Cells, k: int):
        self.names = np.array(rows.column("pk").to_pylist(), dtype=object)
        self.x, self.costs = _array(rows.column("vec").combine_chunks()), _costs(rows.column("near"), k)
        self.cells, self.k = cells, k
        self.visited = np.concatenate([cells.first(cells.bounds(self.x[a:a + 1024])[1], k)
                                       for a in range(0, len(self.x), 1024)])

    def meet(self, held: list, cell: int, kinds: list, chunk: int):
        """What the pool rows of a cell add to the lists of the probes that need them."""
        pool = pa.Table.from_batches(held)
        block = _Block(pool.column("ik").to_pylist(), _array(pool.column("vec").combine_chunks()),
                       pool.column("bias").to_numpy().astype(np.float64), self.cells.metric, self.k)
        own = self.cells.only(cell)
        for a in range(0, len(self.x), chunk):
            at = a + np.flatnonzero(~self.visited[a:a + chunk, cell])
            at = at[own.bounds(self.x[at])[0][:, 0] <= self.costs[at, -1]]
            if not len(at):
                continue
            found = []
            for r, i, val in block.best(self.x[at], limit=self.costs[at, -1]):
                cost = val if block.metric == "l2" else -val
                keep = cost <= self.costs[at[r], -1]
                r, i, val, cost = r[keep], i[keep], val[keep], cost[keep]
                found.append((at[r], cost))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(self.names[at[r]].tolist(), kinds[0]), pa.array(block.keys[i].tolist(), kinds[1]),
                     pa.array(val, pa.float64())], ["pk", "ik", "score"])
            rows, cost = (np.concatenate(x) for x in zip(*found))  # ordered by probe, at most k each
            who, first, n = np.unique(rows, return_index=True, return_counts=True)
            if len(who):
                more = np.full((len(who), n.max()), np.inf)
                more[np.repeat(np.arange(len(who)), n), np.arange(len(rows)) - np.repeat(first, n)] = cost
                more = np.concatenate([self.costs[who], more], axis=1)
                self.costs[who] = np.sort(more, axis=1)[:, :self.k]


def _score_groups(batches, cells: Cells, k: int, kinds: list, chunk: int, block_rows: int):
    """Rows sorted by (group, probe descending, cell): a group's probes, then pool rows by cell."""
    key, held, group, pool, n_pool = None, [], None, [], 0

    def flush():
        if group is not None and pool:
            yield from group.meet(pool, key[1], kinds, chunk)
    for batch in batches:
        marks = [batch.column(c).to_numpy() for c in ("group", "cell", "probe")]
        cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in marks], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            rows, at = batch.slice(lo, hi - lo), (int(marks[0][lo]), int(marks[1][lo]))
            if key is None or at != key or n_pool >= block_rows:
                yield from flush()
                pool, n_pool = [], 0
                if key is None or at[0] != key[0]:
                    held, group = [], None
                key = at
            if marks[2][lo]:
                held.append(rows)
                continue
            if group is None and held:
                group, held = _Group(pa.Table.from_batches(held), cells, k), []
            pool.append(rows)
            n_pool += rows.num_rows
    yield from flush()


def block_topk(probes: DataFrame, pool: DataFrame, k: int, metric: str = "l2",
               probe_key: str = "probe_id", item_key: str = "item_id", vec: str = "vec",
               bias: str | None = None, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
               visits: int = VISITS, chunk: int = 512, group_rows: int | None = None) -> DataFrame:
    """D2 / D7 kernel: for every probe the ``k`` best pool items, exactly.

    ``metric='l2'`` ranks by squared L2 ascending; ``'dot'`` by dot product
    (+ optional per-item ``bias``) descending.  Ties by item key.
    Output ``(probe_key, item_key, score, rank)``.
    """
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    # written before the filter, which would otherwise repeat the vector's expression
    p = cut(probes.select(F.col(probe_key).alias("pk"), _d(F.col(vec)).alias("vec"))).where(whole)
    weight = F.col(bias).cast("double") if bias else F.lit(0.0)
    q = cut(pool.select(F.col(item_key).alias("ik"), _d(F.col(vec)).alias("vec"), weight.alias("bias"))) \
        .where(whole & F.col("ik").isNotNull())
    p_type, i_type = dict(p.dtypes)["pk"], dict(q.dtypes)["ik"]
    schema = f"pk {p_type}, ik {i_type}, score double"
    kinds = [to_arrow_type(p.schema["pk"].dataType), to_arrow_type(q.schema["ik"].dataType)]
    n_pool = q.count()
    if not n_pool:
        return p.sparkSession.createDataFrame([], f"{probe_key} {p_type}, {item_key} {i_type}, score double, rank int")

    n_centres = min(MAX_CENTRES, -(-n_pool // cell_rows))
    sample = q.select("vec").limit(1) if n_centres == 1 else q.select("vec").where(
        F.pmod(F.xxhash64("ik"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_ROWS / n_pool)) + 1)
    rows = np.array([r[0] for r in sample.collect()])
    centres = _fit_centres(rows, n_centres) if len(rows) else np.zeros((1, len(q.first()["vec"])))
    cellular = cut(q.mapInArrow(partial(_assign, centres=centres),
                                f"ik {i_type}, vec array<double>, bias double, cell int, dist double"))
    rows_of, radius, most = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    for c, n, r, b in cellular.groupBy("cell").agg(F.count(F.lit(1)), F.max("dist"), F.max("bias")).collect():
        rows_of[c], radius[c], most[c] = n, r, b  # a row per centre
    cells = Cells(centres, rows_of, radius, most, metric)
    n_parts = F.element_at(F.array(*[F.lit(-(-max(1, int(n)) // block_rows)) for n in rows_of]), F.col("cell") + 1)
    tie = F.monotonically_increasing_id()  # parts rows that share a key too
    blocks = cellular.withColumn("part", F.pmod(F.xxhash64("ik", tie), n_parts).cast("int")).drop("dist")

    def nearest() -> DataFrame:
        seen = cut(p.mapInArrow(partial(_visit, cells=cells, k=k), f"pk {p_type}, vec array<double>, cell int"))
        deals = seen.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / visits).cast("int").alias("deals")).collect()
        if not deals:
            return p.sparkSession.createDataFrame([], schema)
        by_cell = F.create_map(*[F.lit(x) for r in deals for x in r])  # a row per visited cell
        n_deals = F.element_at(by_cell, F.col("cell"))
        one = F.lit(None)
        items = (blocks.where(n_deals.isNotNull())
                 .withColumn("deal", F.explode(F.sequence(F.lit(0), n_deals - 1)))
                 .select("cell", "part", "deal", F.lit(0).alias("probe"), one.cast(p_type).alias("pk"), "ik", "vec", "bias"))
        asked = (seen.withColumn("deal", F.pmod(F.xxhash64("pk", "vec"), n_deals).cast("int"))
                 .withColumn("part", F.explode(F.sequence(F.lit(0), n_parts.cast("int") - 1)))
                 .select("cell", "part", "deal", F.lit(1).alias("probe"), "pk", one.cast(i_type).alias("ik"), "vec",
                         one.cast("double").alias("bias")))
        return (items.unionByName(asked).repartition("cell", "part", "deal")
                .sortWithinPartitions("cell", "part", "deal", "probe")
                .mapInArrow(partial(_score_blocks, metric=metric, k=k, kinds=kinds, chunk=chunk), schema))

    ascending = metric == "l2"
    top = topk_per_key(nearest(), "pk", "score", k, tie="ik", ascending=ascending)
    if int((rows_of > 0).sum()) > 1:
        top = cut(top)
        cost = F.col("score") if ascending else -F.col("score")
        near = top.groupBy("pk").agg(F.sort_array(F.collect_list(cost)).alias("near"))  # k at most
        # neighbouring probes share a group, which then needs few cells where the vectors allow it
        home = p.mapInArrow(partial(_assign, centres=centres), f"pk {p_type}, vec array<double>, cell int, dist double")
        home = cut(home.drop("dist"))
        n_probes = {r[0]: r[1] for r in home.groupBy("cell").agg(F.count(F.lit(1))).collect()}  # a row per centre
        total = sum(n_probes.values())
        most_rows = group_rows or min(GROUP_ROWS, max(2048, -(-total // 32)))
        line = centres @ np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
        base, parts, n_groups, filled = [0] * len(centres), [1] * len(centres), 0, 0
        for c in np.argsort(line, kind="stable").tolist():
            n = n_probes.get(c, 0)
            if filled and filled + n > most_rows:
                n_groups, filled = n_groups + 1, 0
            base[c], parts[c] = n_groups, max(1, -(-n // most_rows))
            n_groups, filled = (n_groups + parts[c], 0) if parts[c] > 1 else (n_groups, filled + n)
        n_groups += 1

        def per_cell(values: list):
            return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cell") + 1)
        spread = F.pmod(F.xxhash64("pk", "vec", tie), per_cell(parts)).cast("int")
        home = cut(home.withColumn("group", per_cell(base) + spread).drop("cell").join(near, "pk", "left")
                   .withColumn("theta", F.when(F.size("near") >= k, F.element_at("near", k))))
        needed = home.select("vec", "group", "theta").mapInArrow(partial(_needed, cells=cells, k=k), "group int, cell int")
        one = F.lit(None)
        held = home.select("group", F.lit(-1).alias("cell"), F.lit(1).alias("probe"), "pk", one.cast(i_type).alias("ik"),
                           "vec", one.cast("double").alias("bias"), "near")
        met = cellular.join(cut(needed.distinct()), "cell").select(
            "group", "cell", F.lit(0).alias("probe"), one.cast(p_type).alias("pk"), "ik", "vec", "bias",
            one.cast("array<double>").alias("near"))
        rest = (held.unionByName(met).repartition(4 * n_groups, "group").sortWithinPartitions("group", "cell")
                .mapInArrow(partial(_score_groups, cells=cells, k=k, kinds=kinds, chunk=chunk,
                                    block_rows=min(block_rows, GROUP_BLOCK)), schema))
        top = topk_per_key(top.select("pk", "ik", "score").unionByName(rest), "pk", "score", k, tie="ik",
                           ascending=ascending)
    return top.select(F.col("pk").alias(probe_key), F.col("ik").alias(item_key), "score", "rank")


def knn_l2(probes: DataFrame, pool: DataFrame, k: int = 300, **kw) -> DataFrame:
    """Exact k nearest by squared L2."""
    return block_topk(probes, pool, k, "l2", **kw)


def dense_dot_scores(probes: DataFrame, pool: DataFrame, k: int, **kw) -> DataFrame:
    """The ``k`` pool rows with the largest dot product per probe."""
    return block_topk(probes, pool, k, "dot", **kw)


# ------------------------------------------------------------------ LSH join

LIST_ENTRIES = 1 << 22  # most entries of the lists that a task of the LSH join holds, about
STREAM_ROWS = 4096      # pool rows that it scores at once
KEPT_KEYS = 1 << 20     # pool keys, about, that it holds beside those that its lists name
WHOLE_SHARE = 4         # buckets that hold one pair in so many, or more, are not met one by one


class _Nearest:
    """The probes of one task with the k nearest of the pool rows that have passed, which come by key.

    Keys are numbered as they come, so a list by score and number is one by score and key: a later
    row enters only below the k-th score, and ties need no comparison of keys.  As in ``_Block``
    float32 selects, with a slack for its error, and float64 decides."""

    def __init__(self, probes: pa.Table, k: int, block: int, chunk: int):
        self.keys, self.k, self.block, self.chunk = probes.column("pk").combine_chunks(), k, block, chunk
        self.x = _array(probes.column("vec").combine_chunks())
        self.own, self.buckets = (self.x * self.x).sum(1), _buckets(probes.column("buckets").combine_chunks())
        self.x32 = np.column_stack([self.x, np.ones(len(self.x))]).astype(np.float32)
        self.score, self.item = np.full((len(self.x), k), np.inf), np.full((len(self.x), k), -1)
        self.names, self.n_names, self.last = [], 0, None
        self.found, self.n_found = [], 0
        self.most_found = min(1 << 21, max(1 << 16, self.score.size // 2))

    def _number(self, keys: pa.Array) -> np.ndarray:
        """The numbers of a block's keys; equal ones, also of the block before, share a number."""
        null = keys.is_null().to_numpy(zero_copy_only=False)
        new = np.ones(len(keys), bool)
        new[1:] = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
        new[1:] |= null[1:] != null[:-1]
        new[0] = self.last is None or self.last.as_py() != keys[0].as_py()
        number = self.n_names - 1 + np.cumsum(new)
        self.names.append(keys.filter(pa.array(new)))
        self.n_names, self.last = self.n_names + int(new.sum()), keys[-1]
        return number

    def meet(self, held: list):
        """Scores pool rows that share a bucket of a table with a probe."""
        pool, first = pa.Table.from_batches(held), self.last is None
        x, buckets = _array(pool.column("vec").combine_chunks()), _buckets(pool.column("buckets").combine_chunks())
        number = self._number(pa.concat_arrays([rows.column("ik") for rows in held]))
        for a in range(0, len(x), self.block):
            part = slice(a, a + self.block)
            self._meet(x[part], buckets[part], number[part])
            if first and not a:
                self.merge()  # most lists have k rows now
        if self.n_names > 2 * self.score.size + KEPT_KEYS:
            self._forget()

    def _meet(self, x: np.ndarray, buckets: np.ndarray, number: np.ndarray):
        x2 = (x * x).sum(1)
        x32 = np.column_stack([-2 * x, x2]).astype(np.float32).T
        # rows of one key may count once: so many rows have k keys
        enough = min(len(x), self.k * int(np.bincount(number - number[0]).max()))
        for lo in range(0, len(self.x), self.chunk):
            at = slice(lo, lo + self.chunk)
            s, limit = self.x32[at] @ x32, self.score[at, -1]
            thr = limit - self.own[at]
            short = np.flatnonzero(np.isinf(limit))  # lists of fewer than k
            if len(short):
                shared = _share(self.buckets[lo + short], buckets)
                more = np.flatnonzero(np.count_nonzero(shared, axis=1) > enough)  # the others' rows are all near
                few = np.where(shared[more], s[short[more]], np.inf)
                thr[short[more]] = np.partition(few, enough - 1, axis=1)[:, enough - 1]
            thr = thr + 1e-5 * (1.0 + self.own[at] + x2.max()) + 1e-6
            near = ~(s > thr[:, None].astype(s.dtype))  # what overflows is scored
            if len(short):
                near[short] &= shared
            rows, items = np.divmod(np.flatnonzero(near), len(x))
            rows += lo
            ok = np.zeros(len(rows), bool)
            for mine, its in zip(self.buckets.T, buckets.T):
                ok |= mine[rows] == its[items]
            rows, items = rows[ok], items[ok]
            score = np.round(_distances(self.x, x, rows, items), 6) + 0.0
            ok = score < self.score[rows, -1]
            self.found.append((rows[ok].astype(np.min_scalar_type(len(self.x))), score[ok], number[items[ok]]))
            self.n_found += int(ok.sum())
            if self.n_found > self.most_found:
                self.merge()

    def merge(self):
        """Puts what was found into the lists; equal rows of a list count once."""
        if not self.n_found:
            return
        rows, score, item = (np.concatenate(x) for x in zip(*self.found))
        self.found, self.n_found = [], 0
        order = np.argsort(rows, kind="stable")  # a probe's stay in the order of their keys
        score, item = score[order], item[order]
        who, n = np.unique(rows, return_counts=True)
        ends = np.cumsum(n)
        step = max(1, (1 << 21) // (self.k + int(n.max(initial=0))))
        for lo in range(0, len(who), step):
            part, size = who[lo:lo + step], n[lo:lo + step]
            start, end = ends[lo] - size[0], ends[lo:lo + step][-1]
            place = (np.repeat(np.arange(len(part)), size),
                     self.k + np.arange(end - start) - np.repeat(np.cumsum(size) - size, size))
            s, i = np.full((len(part), self.k + size.max()), np.inf), np.full((len(part), self.k + size.max()), -1)
            s[:, :self.k], i[:, :self.k] = self.score[part], self.item[part]
            s[place], i[place] = score[start:end], item[start:end]
            s, i = _by_score(s, i)
            again = (s[:, 1:] == s[:, :-1]) & (i[:, 1:] == i[:, :-1]) & (i[:, 1:] >= 0)
            if again.any():
                s[:, 1:][again], i[:, 1:][again] = np.inf, -1
                s, i = _by_score(s, i)
            self.score[part], self.item[part] = s[:, :self.k], i[:, :self.k]

    def _forget(self):
        """Drops the keys that no list names; the others keep their order."""
        self.merge()
        used = np.union1d(self.item[self.item >= 0], [self.n_names - 1])
        self.names = [pa.concat_arrays(self.names).take(pa.array(used))]
        self.item = np.where(self.item >= 0, np.searchsorted(used, self.item), -1)
        self.n_names = len(used)

    def lists(self):
        """The lists, in order, with ranks from 1."""
        self.merge()
        names = pa.concat_arrays(self.names)
        for lo in range(0, len(self.x), self.chunk):
            rows, rank = np.nonzero(self.item[lo:lo + self.chunk] >= 0)
            rows += lo
            yield pa.RecordBatch.from_arrays(
                [self.keys.take(pa.array(rows)), names.take(pa.array(self.item[rows, rank])),
                 pa.array(self.score[rows, rank]), pa.array(rank + 1, pa.int32())], ["pk", "ik", "score", "rank"])


def _buckets(column) -> np.ndarray:
    """A row's bucket in each table."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` share a bucket of a table."""
    out = np.zeros((len(a), len(b)), bool)
    for x, y in zip(a.T, np.ascontiguousarray(b.T)):
        out |= x[:, None] == y[None]
    return out


def _by_score(score: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(score, axis=1, kind="stable")
    return np.take_along_axis(score, order, 1), np.take_along_axis(item, order, 1)


def _stream_pool(batches, k: int, names: tuple, block_rows: int, chunk: int):
    """Rows sorted by a group's ``names``: its probes, then pool rows by key, which stream past them."""
    key, held, nearest, pool, n_pool = None, [], None, [], 0

    def lists():
        if nearest is not None:
            if pool:
                nearest.meet(pool)
            yield from nearest.lists()
    for batch in batches:
        marks = [batch.column(c).to_numpy() for c in (*names, "probe")]
        cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in marks], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            rows, at = batch.slice(lo, hi - lo), tuple(int(x[lo]) for x in marks[:-1])
            if at != key:
                yield from lists()
                key, held, nearest, pool, n_pool = at, [], None, [], 0
            if marks[-1][lo]:
                held.append(rows)
                continue
            if nearest is None:
                if not held:
                    continue
                nearest, held = _Nearest(pa.Table.from_batches(held), k, block_rows, chunk), []
            pool.append(rows)
            n_pool += rows.num_rows
            if n_pool >= block_rows:
                nearest.meet(pool)
                pool, n_pool = [], 0
    yield from lists()


def knn_lsh_join(probes: DataFrame, pool: DataFrame, k: int, probe_key: str = "probe_id",
                 item_key: str = "item_id", vec: str = "vec", bucket_length: float = 0.5,
                 num_tables: int = 4, seed: int = 42, group_rows: int | None = None,
                 block_rows: int = STREAM_ROWS, chunk: int = 256) -> DataFrame:
    """Approximate k-NN for pools too big for D2, via Spark ML's
    random-projection LSH (Euclidean distance): pairs that share a bucket of a table.  A task
    holds a group of probes with their lists so far and streams pool rows past it, so no pair leaves
    it but a listed one.  Groups are portions of a bucket's probes; where the buckets hold a
    large share of all pairs (wide buckets), they are portions of all probes instead, which meet
    each pool row once, not once per table, and give whole lists.  Equal rows count once.  Rows whose
    vector is null or holds a null are left out; an empty side gives no rows."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array
    whole = F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())
    # written after the filter too: the conversion below must not meet a row that it drops
    probes, pool = cut(cut(probes.select(probe_key, vec)).where(whole)), cut(cut(pool.select(item_key, vec)).where(whole))
    p_type, i_type = dict(probes.dtypes)[probe_key], dict(pool.dtypes)[item_key]
    if pool.isEmpty():  # nothing to fit the projections on
        return probes.sparkSession.createDataFrame([], f"{probe_key} {p_type}, {item_key} {i_type}, score double, rank int")

    def vectors(df: DataFrame, key: str, name: str) -> DataFrame:
        """The distinct rows."""
        v = F.col(vec) if dict(df.dtypes)[vec] == "array<float>" else _d(F.col(vec))
        rows = df.select(F.col(key).alias(name), v.alias("vec")).distinct()
        return rows.withColumn("features", array_to_vector(_d(F.col("vec"))))
    a, b = vectors(probes, probe_key, "pk"), vectors(pool, item_key, "ik")
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes",
                                      bucketLength=bucket_length, numHashTables=num_tables, seed=seed).fit(b)
    buckets = F.array(*[vector_to_array(F.col("hashes")[t])[0].cast("long") for t in range(num_tables)])
    left, right = (cut(lsh.transform(df).select(name, "vec", buckets.alias("buckets")))
                   for df, name in ((a, "pk"), (b, "ik")))
    n_left, n_right = left.count(), right.count()
    held = max(1, min(k, n_right))
    group_rows = group_rows or min(GROUP_ROWS, max(1, LIST_ENTRIES // held), max(2048, -(-n_left // 32)))
    where = ["table", "bucket"]

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.posexplode("buckets").alias(*where)).groupBy(*where).agg(F.count(F.lit(1)).alias(name))
    both = cut(sizes(right, "items").join(sizes(left, "asked"), where))
    pairs = both.agg(F.sum(F.col("items").cast("double") * F.col("asked"))).first()[0] or 0.0
    together = WHOLE_SHARE * pairs >= n_left * n_right > 0
    some, none = F.monotonically_increasing_id(), F.lit(None)
    if together:
        n_groups, slots = -(-n_left // group_rows), probes.sparkSession.sparkContext.defaultParallelism
        if n_groups > slots:  # no last round of few tasks
            n_groups = -(-n_groups // slots) * slots
        names = ("group",)
        asked = left.withColumn("group", F.pmod(some, F.lit(n_groups)).cast("int"))
        items = right.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    else:
        names = (*where, "deal")
        deals = both.select(*where, F.ceil(F.col("asked") / group_rows).cast("int").alias("deals"))
        by_bucket = "*", F.posexplode("buckets").alias(*where)
        asked = (left.select(*by_bucket).withColumn("_n", some).join(deals, where)
                 .withColumn("deal", F.pmod("_n", "deals").cast("int")))
        items = (right.select(*by_bucket).join(deals, where)
                 .withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))))
    rows = items.select(*names, F.lit(0).alias("probe"), none.cast(p_type).alias("pk"), "ik", "vec", "buckets").unionByName(
        asked.select(*names, F.lit(1).alias("probe"), "pk", none.cast(i_type).alias("ik"), "vec", "buckets"))
    rows = rows.repartitionById(n_groups, "group") if together else rows.repartition(*names)
    r = (rows.sortWithinPartitions(*names, F.col("probe").desc(), "ik")
         .mapInArrow(partial(_stream_pool, k=held, names=names, block_rows=block_rows, chunk=chunk),
                     f"pk {p_type}, ik {i_type}, score double, rank int")
         .select(F.col("pk").alias(probe_key), F.col("ik").alias(item_key), "score", "rank"))
    if together and left.groupBy("pk").count().where("count > 1").isEmpty():
        return r.where(F.col("rank") <= k)  # a key's list is whole
    return topk_per_key(r.drop("rank").distinct(), probe_key, "score", k, tie=item_key, ascending=True)
