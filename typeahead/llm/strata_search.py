"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through an integer normaliser ``m``, so documents
of equal ``m`` form a stratum, and inside a stratum all postings of a term with the same
``tf`` have the same impact.  The index is cut into shards of about ``shard_terms`` distinct
terms: consecutive strata share a shard and a large stratum is spread over several by a hash
of the row.  A shard holds, per term, its postings ordered by (m, falling tf); each run of
equal (m, tf) is stored once with its number of documents.

A query meets the shards that hold its terms.  There the impact of every (m, tf) run is
computed once, a stratum's bound is the sum of its terms' largest impacts, and strata are
visited by falling bound, until no bound left reaches the k-th score found.  Shard lists are
merged by rank.  The result is exact; bounds only save visits.

Scores are 64-bit integers.  Null or empty text has no terms and is never found; ties go to
the smaller id (a null id last); rows that repeat an id are ranked as rows of their own; rows
that repeat an item are one item, and a null item id or an item without known terms finds nothing.
Empty tables give no rows; columns not named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import lower_ascii, stage, table
from .queries import register

# Fixed value: the characters of a term, once A-Z is lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN_TERMS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SHARD_TERMS = 2_000_000  # distinct terms of documents per shard, about
ITEM_BLOCK = 500         # queries scored together in one shard
BATCH_TERMS = 300_000    # distinct terms that a worker holds as Python strings, about


class Index(NamedTuple):
    postings: DataFrame  # shard, term, m, tf (lists, one entry per run), n (run lengths), docs (row numbers in the shard)
    rows: DataFrame      # shard, ids (by row number)
    df: DataFrame        # term, df
    n_docs: int          # documents with a term
    n_terms: int         # terms of all documents, with repeats


def term_counts(batches):
    """Per document: id, number of terms, distinct terms and how often each occurs."""
    find = re.compile(TERM.encode()).findall  # every byte of a longer UTF-8 sequence is a term's

    def counted(ids, n, ends, terms, tfs):
        offsets = pa.array(ends, pa.int32())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()),
             pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
             pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))], ["id", "n", "terms", "tfs"])

    for batch in batches:
        ids, texts = batch.column(0), pc.cast(batch.column(1), pa.binary())
        first, n, ends, terms, tfs = 0, [], [0], [], []
        for i in range(len(ids)):
            counts = Counter(find((texts[i].as_py() or b"").lower()))
            n.append(counts.total())
            terms.extend(counts.keys())
            tfs.extend(counts.values())
            ends.append(len(terms))
            if len(terms) > BATCH_TERMS or i + 1 == len(ids):
                yield counted(ids.slice(first, i + 1 - first), n, ends, terms, tfs)
                first, n, ends, terms, tfs = i + 1, [], [0], [], []


def partial_df(batches):
    """Documents per term, added up within each batch."""
    for batch in batches:
        seen = pc.value_counts(batch.column(0).flatten())
        yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["term", "df"])


def index_shard(docs: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Postings of one shard, runs of equal (m, tf) per term, and its numbered rows."""
    docs = docs.sort_by([("m", "ascending"), ("id", "ascending"), ("row", "ascending")])
    lists = docs.column("terms").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    term = coded.indices.to_numpy(zero_copy_only=False)
    tf = pc.list_flatten(docs.column("tfs").combine_chunks()).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    m = docs.column("m").to_numpy()[doc]
    order = np.lexsort((-tf, m, term))  # stable: equal runs keep rising row numbers
    term, m, tf, doc = term[order], m[order], tf[order], doc[order]
    new_term = np.flatnonzero(np.diff(term, prepend=-1))
    new_run = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(m, prepend=-1) != 0)
                             | (np.diff(tf, prepend=-1) != 0))
    run_ends = pa.array(np.append(np.searchsorted(new_run, new_term), len(new_run)).astype(np.int32))
    doc_ends = pa.array(np.append(new_term, len(term)).astype(np.int32))

    def runs(values, kind):
        return pa.ListArray.from_arrays(run_ends, pa.array(values, kind))
    postings = pa.table({
        "term": coded.dictionary.take(pa.array(term[new_term])),
        "m": runs(m[new_run], pa.int64()), "tf": runs(tf[new_run], pa.int32()),
        "n": runs(np.diff(np.append(new_run, len(term))), pa.int32()),
        "docs": pa.ListArray.from_arrays(doc_ends, pa.array(doc, pa.int32()))})
    return postings, docs.select(["id"])


POSTINGS = "shard long, term string, m array<long>, tf array<int>, n array<int>, docs array<int>, ids array<long>"


def build_shard(docs: pa.Table) -> pa.Table:
    """Rows of POSTINGS: a row per term, and one (term null) that lists the shard's ids."""
    shard = docs.column("shard")[0].as_py()
    postings, rows = index_shard(docs)
    ids = rows.column("id").combine_chunks()
    head = pa.table({"term": pa.array([None], pa.string()), "m": pa.array([[]], pa.list_(pa.int64())),
                     **{c: pa.array([[]], pa.list_(pa.int32())) for c in ("tf", "n", "docs")},
                     "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)})
    body = postings.append_column("ids", pa.nulls(len(postings), pa.list_(pa.int64())))
    out = pa.concat_tables([head, body])
    return out.add_column(0, "shard", pa.array(np.full(len(out), shard, np.int64)))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shard_terms: int = SHARD_TERMS) -> Index:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = stage(rows.mapInArrow(term_counts, "id long, n long, terms array<string>, tfs array<int>")
                    .filter("n > 0"), "search-terms")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = stage(counted.select("terms").mapInArrow(partial_df, "term string, df long")
               .groupBy("term").agg(F.sum("df").alias("df")), "search-df")

    # normalisers in rising order with the weight before each give every row its shard
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    weight = F.size("terms")
    keyed = counted.withColumn("m", m).withColumn("row", F.monotonically_increasing_id())
    strata = keyed.groupBy("m").agg(F.sum(weight).alias("held"))
    upto = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)  # one row per normaliser
    strata = stage(strata.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0))), "search-strata")
    spread = F.pmod(F.xxhash64("id", "row"), F.lit(1 << 20)) / (1 << 20)
    placed = (keyed.join(strata, "m")
              .withColumn("shard", F.floor((F.col("before") + spread * F.col("held")) / shard_terms))
              .select("shard", "m", "id", "row", "terms", "tfs"))
    postings = stage(placed.groupBy("shard").applyInArrow(build_shard, POSTINGS), "search-index")
    return Index(postings.filter("term IS NOT NULL").drop("ids"),
                 postings.filter("term IS NULL").select("shard", "ids"), df, n_docs, n_terms)


class Shard:
    """The postings of some terms in one shard, ready for scoring."""

    def __init__(self, postings: pa.Table, ids: np.ndarray):
        def flat(name):
            lists = postings.column(name).combine_chunks()
            return (pc.list_flatten(lists).to_numpy(zero_copy_only=False),
                    np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]))
        m, self.run_at = flat("m")
        tf, _ = flat("tf")
        n, _ = flat("n")
        self.docs, self.doc_at = flat("docs")
        self.ids = ids
        w = np.repeat(postings.column("w").to_numpy(), np.diff(self.run_at))
        tf = tf.astype(np.int64)
        impact = w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))  # once per (term, m, tf)
        self.strata, self.stratum_of_run = np.unique(m, return_inverse=True)
        self.impact_of_run = impact
        self.impacts = np.repeat(impact, n)
        self.stratum = np.repeat(self.stratum_of_run, n).astype(np.int32)

    def top(self, terms: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows for (term's row, repeats), best first."""
        bound = np.zeros(len(self.strata), np.int64)
        for t, times in terms:
            runs = slice(self.run_at[t], self.run_at[t + 1])
            best = np.zeros(len(bound), np.int64)
            np.maximum.at(best, self.stratum_of_run[runs], self.impact_of_run[runs])
            bound += times * best
        visits = np.argsort(-bound, kind="stable")
        visits = visits[bound[visits] > 0]
        scores = np.zeros(len(self.ids), np.int64)
        floor, step, at = 0, 1, 0
        while at < len(visits) and bound[visits[at]] >= max(floor, 1):
            now = np.zeros(len(bound), bool)
            now[visits[at:at + step]] = True
            for t, times in terms:
                span = slice(self.doc_at[t], self.doc_at[t + 1])
                hit = now[self.stratum[span]]
                scores[self.docs[span][hit]] += times * self.impacts[span][hit]
            at, step = at + step, 4 * step
            found = scores[scores > 0]
            if len(found) >= k:
                floor = int(np.partition(found, len(found) - k)[len(found) - k])
        rows = np.flatnonzero(scores >= max(floor, 1))
        order = np.lexsort((rows, self.ids[rows], -scores[rows]))[:k]
        return rows[order], scores[rows[order]]


FOUND = "item_id string, id long, null_id boolean, score long"


def search_shard(postings: pa.Table, heads: pa.Table, k: int) -> pa.Table:
    """The best rows of a shard for each query of one block."""
    out = {"item_id": [], "id": [], "null_id": [], "score": []}
    if len(postings) and len(heads):
        ids = heads.column("ids")[0].values
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        numbers = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        shard = Shard(postings, numbers)
        queries: dict[str, list[tuple[int, int]]] = {}
        for t, (items, times) in enumerate(zip(postings.column("items").to_pylist(), postings.column("times").to_pylist())):
            for item, n in zip(items, times):
                queries.setdefault(item, []).append((t, n))
        for item, terms in queries.items():
            rows, scores = shard.top(terms, k)
            out["item_id"] += [item] * len(rows)
            out["id"] += numbers[rows].tolist()
            out["null_id"] += null[rows].tolist()
            out["score"] += scores.tolist()
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64()]
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})


def search(index: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (as string), rank, id, score of the k best documents of each item."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), BETWEEN_TERMS), "")
    queries = (items.select(F.col(item_col).cast("string").alias("item_id"), words.alias("words"))
               .filter("item_id IS NOT NULL").distinct())
    w = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    blocks = max(1, -(-queries.count() // ITEM_BLOCK))
    wanted = stage(queries.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
                   .withColumn("term", F.explode("words"))
                   .groupBy("block", "item_id", "term").agg(F.count("*").alias("times"))
                   .groupBy("block", "term").agg(F.collect_list(F.struct("item_id", "times")).alias("q"))
                   .join(index.df, "term")
                   .select("block", "term", w.cast("long").alias("w"), F.col("q.item_id").alias("items"),
                           F.col("q.times").alias("times")), "search-queries")
    met = index.postings.join(wanted, "term")
    blocks_of_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    heads = index.rows.select(F.col("shard").alias("at_shard"), blocks_of_shard.alias("at_block"), "ids")

    def find(postings: pa.Table, heads: pa.Table) -> pa.Table:
        return search_shard(postings, heads, k)

    found = met.groupBy("shard", "block").cogroup(heads.groupBy("at_shard", "at_block")).applyInArrow(find, FOUND)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "null_id", "id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("item_id", "rank", F.when(~F.col("null_id"), F.col("id")).alias("id"), "score"))


@register("op12_strata_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
m AS (SELECT doc_id, 75 + (25 * CAST(len(ws) AS BIGINT) * n_docs) // n_terms AS m FROM d, g WHERE len(ws) > 0),
s AS (SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT)
               * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN df USING (term) JOIN m USING (doc_id), g GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""")
def op12(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    found = search(build_index(table(spark, sf_dir, "documents")), items)
    return found.select(F.col("item_id").cast(items.schema["item_id"].dataType), "rank", F.col("id").alias("doc_id"), "score")
