"""Lexical retrieval: char-n-gram Okapi BM25 (B1-B3) and hashed BM25.

The index is a long-form posting table ``(gram, query, tf, dl, w)`` over the pool's
distinct queries.  Exhaustive scoring of a batch of prefixes is one equi-join on ``gram``
plus a ``groupBy(prefix, query).sum`` with map-side partial aggregation; the top-k meets
shards of the index instead (``bm25_topk``), so that no pair but a listed one is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import add_char_ngrams, md5_int, word_tokens
from ..session import cut
from .topk import topk_per_key

# Okapi BM25 defaults of the scorer the reference calls.
OKAPI_K1 = 1.5
OKAPI_B = 0.75
OKAPI_EPSILON = 0.25
# The hashed variant's parameters.
HASHED_K1 = 1.6
HASHED_B = 0.75
HASHED_FEATURES = 2 ** 16


@dataclass
class BM25Index:
    postings: DataFrame      # gram, query, tf, dl, w (doc-side BM25 weight)
    idf: DataFrame           # gram, df, idf
    n_docs: int
    avgdl: float
    k1: float = OKAPI_K1
    b: float = OKAPI_B


def bm25_postings(pool: DataFrame, text: str = "query", n: int = 3) -> DataFrame:
    """B1: ``(query, gram, tf)`` plus the document length ``dl`` (grams with repeats)."""
    # a small table's distinct rows lie in one partition; the grams are the costly part
    rows = pool.select(F.col(text).alias("query")).repartition(pool.sparkSession.sparkContext.defaultParallelism)
    docs = add_char_ngrams(rows, "query", "grams", n)
    # explode would push a size filter that cuts the text once more for every gram
    docs = docs.select("query", F.size("grams").alias("dl"), F.explode_outer("grams").alias("gram"))
    return docs.where(F.col("gram").isNotNull()).groupBy("gram", "query", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(pool: DataFrame, text: str = "query", n: int = 3,
               k1: float = OKAPI_K1, b: float = OKAPI_B, epsilon: float = OKAPI_EPSILON) -> BM25Index:
    """B1 + B2: postings with precomputed doc weights, and IDF per gram.

    ``N`` counts every pool row (empty ones too); ``avgdl`` is total grams / N.
    IDF is ``ln(N-df+0.5) - ln(df+0.5)``; a negative IDF is replaced by
    ``epsilon`` times the mean IDF over the vocabulary.  The three scalars
    come from one-row aggregates.
    """
    from ..session import reuse
    post = reuse(bm25_postings(pool, text, n))
    n_docs = int(pool.count())
    total = post.agg(F.sum("tf")).first()[0] or 0
    avgdl = float(total) / n_docs if n_docs else 0.0
    df = post.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = reuse(df.withColumn("idf_raw", raw))
    mean_idf = df.agg(F.avg("idf_raw")).first()[0] or 0.0
    idf = df.select("gram", "df", F.when(F.col("idf_raw") < 0, F.lit(epsilon * mean_idf))
                    .otherwise(F.col("idf_raw")).alias("idf"))
    denom = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl))
    post = cut(post.withColumn("w", F.col("tf") * F.lit(k1 + 1) / denom))
    return BM25Index(post, reuse(idf), n_docs, avgdl, k1, b)


def bm25_corpus_stats(index: BM25Index) -> DataFrame:
    """B2 as a table: per gram df and idf, with N and avgdl as columns."""
    return index.idf.select("gram", "df", "idf",
                            F.lit(index.n_docs).cast("bigint").alias("n_docs"),
                            F.lit(index.avgdl).alias("avgdl"))


def prefix_grams(prefixes: DataFrame, col: str = "prefix", n: int = 3) -> DataFrame:
    """Distinct prefixes exploded to ``(prefix, gram, qtf)``; a gram repeated
    in the prefix counts once per occurrence."""
    p = add_char_ngrams(prefixes.select(col).distinct(), col, "grams", n)
    p = p.select(col, F.explode_outer("grams").alias("gram")).where(F.col("gram").isNotNull())
    return p.groupBy(col, "gram").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_scores(index: BM25Index, prefixes: DataFrame, col: str = "prefix", n: int = 3) -> DataFrame:
    """All ``(prefix, candidate, bm25_score)`` with a score from a shared gram."""
    pg = prefix_grams(prefixes, col, n).join(index.idf, "gram")
    j = pg.join(index.postings.select("gram", "query", "w"), "gram")
    return (j.groupBy(col, F.col("query").alias("candidate"))
            .agg(F.round(F.sum(F.col("qtf") * F.col("idf") * F.col("w")), 6).alias("bm25_score")))


SHARD_QUERIES = 131_072  # pool queries, about, that a task holds with their postings
SHARD_PREFIXES = 65_536  # prefixes, about, that a task scores against its shard
FEW_PREFIXES = 256       # as many, about, while there are fewer than 8 tasks a shard


class _Shard:
    """The postings of one task's queries by gram; queries are numbered in text order."""

    def __init__(self, rows: pa.Table):
        texts = rows.column("text").to_pylist()
        order = np.array(sorted(range(len(texts)), key=texts.__getitem__), dtype=np.int64)
        self.texts = np.array(texts, dtype=object)[order]
        place = np.empty(len(texts), dtype=np.int64)
        place[order] = np.arange(len(texts))
        held = rows.column("grams").combine_chunks()
        grams = held.flatten().dictionary_encode()
        code = grams.indices.to_numpy()
        by = np.argsort(code, kind="stable")
        self.at = np.repeat(place, held.value_lengths().to_numpy())[by]
        self.w = rows.column("weights").combine_chunks().flatten().to_numpy()[by]
        self.code = {g: i for i, g in enumerate(grams.dictionary.to_pylist())}
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.code)))])

    def best(self, grams: list, values: list, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the queries that share a gram, and their scores; ties go to the text."""
        total, met = np.zeros(len(self.texts)), np.zeros(len(self.texts), dtype=bool)
        for g, v in zip(grams, values):
            c = self.code.get(g)
            if c is not None:
                own = slice(self.ends[c], self.ends[c + 1])
                total[self.at[own]] += v * self.w[own]
                met[self.at[own]] = True
        found = np.flatnonzero(met)
        score = np.round(total[found], 6) + 0.0
        if len(found) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[keep], score[keep]
        order = np.lexsort((found, -score))[:k]
        return found[order], score[order]


def _score_shards(batches, k: int):
    """Rows sorted by (shard, deal, probe): a shard's queries, then the prefixes to score."""
    key, held, shard = None, [], None
    for batch in batches:
        marks = [batch.column(c).to_numpy() for c in ("shard", "deal", "probe")]
        cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in marks], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            rows = batch.slice(lo, hi - lo)
            at = tuple(int(x[lo]) for x in marks[:2])
            if at != key:
                key, held, shard = at, [], None
            if not marks[2][lo]:
                held.append(rows)
                continue
            if not held and shard is None:
                continue
            if shard is None:
                shard, held = _Shard(pa.Table.from_batches(held)), []
            for a in range(0, rows.num_rows, 64):
                part = rows.slice(a, 64)
                names = np.array(part.column("text").to_pylist(), dtype=object)
                best = [shard.best(g, v, k) for g, v in zip(part.column("grams").to_pylist(),
                                                            part.column("weights").to_pylist())]
                found, score = (np.concatenate(x) for x in zip(*best))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, [len(f) for f, _ in best]).tolist(), pa.string()),
                     pa.array(shard.texts[found].tolist(), pa.string()), pa.array(score, pa.float64())],
                    ["pk", "candidate", "bm25_score"])


def bm25_topk(index: BM25Index, prefixes: DataFrame, k: int = 300,
              col: str = "prefix", n: int = 3, prune: bool = True) -> DataFrame:
    """Top ``k`` candidates per prefix by BM25, ties by candidate text.

    With ``prune`` a query's postings of the grams asked for go, as one row, to the shard that
    a hash of its text gives; a task holds one shard by gram and streams the prefixes past it,
    adding a gram's postings at once, and gives each prefix's ``k`` best, so no (prefix, query)
    pair is shuffled but these.  Where prefixes are many they are dealt to further copies of
    a shard.  Without ``prune`` all pairs are joined and summed.

    A null or empty prefix has no grams and no rows; repeated prefixes count once; queries that
    share no gram are not listed.
    """
    if not prune:
        return topk_per_key(bm25_scores(index, prefixes, col, n), col, "bm25_score", k)
    pg = cut(prefix_grams(prefixes, col, n).join(index.idf, "gram")
             .select(F.col(col).alias("text"), "gram", (F.col("qtf") * F.col("idf")).alias("v")))
    n_asked = pg.select("text").distinct().count()
    n_shards = -(-max(index.n_docs, 1) // SHARD_QUERIES)
    n_deals = max(-(-n_asked // SHARD_PREFIXES), min(8, -(-n_asked // FEW_PREFIXES)), 1)

    def per_text(rows: DataFrame, weight: str) -> DataFrame:
        g = rows.groupBy("text").agg(F.collect_list(F.struct("gram", weight)).alias("g"))
        return g.select("text", F.col("g.gram").alias("grams"), F.col(f"g.{weight}").alias("weights"))

    def number(n_parts: int):
        return F.pmod(F.xxhash64("text"), F.lit(n_parts)).cast("int")

    def every(n_parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))

    columns = ["shard", "deal", "probe", "text", "grams", "weights"]
    post = index.postings.join(pg.select("gram").distinct(), "gram", "left_semi")
    held = (per_text(post.withColumnRenamed("query", "text"), "w").withColumn("shard", number(n_shards))
            .withColumn("deal", every(n_deals)).withColumn("probe", F.lit(0)))
    asked = (per_text(pg, "v").withColumn("deal", number(n_deals))
             .withColumn("shard", every(n_shards)).withColumn("probe", F.lit(1)))
    scored = (held.select(*columns).unionByName(asked.select(*columns)).repartition("shard", "deal")
              .sortWithinPartitions("shard", "deal", "probe")
              .mapInArrow(partial(_score_shards, k=k), "pk string, candidate string, bm25_score double"))
    return topk_per_key(scored.withColumnRenamed("pk", col), col, "bm25_score", k)


# ---------------------------------------------------------------- hashed BM25

@dataclass
class HashedBM25:
    doc_weights: DataFrame   # query, bucket, w
    bucket_df: DataFrame     # bucket, df
    n_docs: int
    avgdl: float


def hashed_buckets(df: DataFrame, col: str, n_features: int = HASHED_FEATURES, tokens=word_tokens) -> DataFrame:
    """Distinct ``(col, bucket)`` pairs: the words that ``tokens`` makes of a column, hashed
    into ``n_features`` buckets, binary (a bucket counts once per text)."""
    toks = df.select(col, F.explode(tokens(col)).alias("tok"))
    return toks.select(col, (md5_int("tok") % n_features).cast("int").alias("bucket")).distinct()


def bm25_hashed_fit(pool: DataFrame, text: str = "query",
                    n_features: int = HASHED_FEATURES,
                    k1: float = HASHED_K1, b: float = HASHED_B, tokens=word_tokens) -> HashedBM25:
    """B4 + B5: N, mean distinct-bucket count, bucket df and doc weights
    ``1 / (k1(1-b+b·dl/avgdl) + 1)`` (binary tf).  ``tokens`` maps a column to its words; the
    same one must be given to ``bm25_hashed_query_weights``."""
    from ..session import reuse
    docs = pool.select(F.col(text).alias("query"))
    buckets = reuse(hashed_buckets(docs, "query", n_features, tokens))
    dl = reuse(buckets.groupBy("query").agg(F.count(F.lit(1)).alias("dl")))
    n_docs = int(docs.count())
    total = dl.agg(F.sum("dl")).first()[0] or 0
    avgdl = float(total) / n_docs if n_docs else 0.0
    bdf = reuse(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")))
    w = buckets.join(dl, "query").select(
        "query", "bucket",
        (F.lit(1.0) / (F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl)) + 1.0)).alias("w"))
    return HashedBM25(w, bdf, n_docs, avgdl)


def bm25_hashed_query_weights(model: HashedBM25, prefixes: DataFrame, col: str = "prefix",
                              n_features: int = HASHED_FEATURES, tokens=word_tokens) -> DataFrame:
    """Per prefix bucket ``idf = ln((N+1)/(df+0.5))`` (df 0 when unseen),
    divided by the prefix's idf sum, and its L2-normalised form."""
    qb = hashed_buckets(prefixes.select(col).distinct(), col, n_features, tokens)
    j = qb.join(model.bucket_df, "bucket", "left").na.fill(0, ["df"])
    j = j.withColumn("idf", F.log(F.lit(model.n_docs + 1.0) / (F.col("df") + 0.5)))
    w = Window.partitionBy(col)
    j = j.withColumn("q_weight", F.col("idf") / F.sum("idf").over(w))
    return j.withColumn("q_weight_l2", F.col("q_weight") / (F.sqrt(F.sum(F.col("q_weight") ** 2).over(w)) + 1e-10))


def sparse_dot_scores(qw: DataFrame, model: HashedBM25, col: str = "prefix",
                      weight: str = "q_weight") -> DataFrame:
    """Σ prefix weight × doc weight over shared buckets."""
    j = qw.select(col, "bucket", weight).join(model.doc_weights, "bucket")
    return (j.groupBy(col, F.col("query").alias("candidate"))
            .agg(F.sum(F.col(weight) * F.col("w")).alias("sparse_score")))
