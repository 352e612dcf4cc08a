"""Hybrid retrieval (D9): dense + hashed-BM25 sparse + weighted popularity.

The score of a pool query is ``dense + sparse + w·pop``; the sparse part is the query's
length weight times the prefix weights of the buckets they share, and zero without one.
The exact top k is found as by a threshold algorithm over two ordered lists:

1. the kernel gives each prefix its k best queries by ``dense + w·pop``, scored in full here.
   Their k-th full score is a threshold θ for the final list, and the k-th ``dense + w·pop``
   is a bound δ for every query not among them;
2. a bucket's queries of equal weight form a block.  A prefix's buckets are taken by falling
   weight, and a query counts for the first one it shares, so the sparse part of a block's
   queries is at most the block's weight times the weights from that bucket on.  Only blocks
   that can lift δ to θ are read.  Buckets and blocks that common words make long have small
   weights and stay unread.

Null prefixes are left out, repeated ones count once, pool rows are distinct; a prefix or
query without words has no sparse part; ties go to the candidate's text; an empty pool or
test table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators import dense as D
from ..operators import lexical as L
from ..operators.popularity import hybrid_pool_popularity
from ..operators.topk import collect_ranked_list, topk_per_key
from ..session import cut


def hybrid_topk(test: DataFrame, pool: DataFrame, features: DataFrame, k: int = 150,
                alpha: float = 0.5, pop_weight: float = 0.2, prune: bool = True,
                encode=D.embed_text, tokens=word_tokens) -> DataFrame:
    """``(prefix, candidate, hybrid_score, rank)``, top ``k`` per distinct prefix.

    ``encode(df, column, out)`` adds a vector column, ``tokens(column)`` gives its words."""
    prefixes = cut(test.select("prefix").where(F.col("prefix").isNotNull()).distinct())
    m = L.bm25_hashed_fit(pool, "query", tokens=tokens)
    qw = L.bm25_hashed_query_weights(m, prefixes, tokens=tokens).withColumn("hs", F.col("q_weight_l2") * (1 - alpha))
    onward = Window.partitionBy("prefix").orderBy("hs", F.col("bucket").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    qw = cut(qw.withColumn("onward", F.sum("hs").over(onward)).select("prefix", "bucket", "hs", "onward"))
    asked = qw.groupBy("prefix").agg(F.collect_list(F.struct("bucket", "hs")).alias("asked"))
    te = cut(encode(prefixes, "prefix", "vec").select("prefix", D.scale_l2("vec", alpha).alias("h"))
             .join(asked, "prefix", "left"))

    weights = cut(m.doc_weights)
    held = weights.groupBy("query").agg(F.collect_list("bucket").alias("buckets"), F.max("w").alias("w"))
    pop = hybrid_pool_popularity(pool, features).select("query", (F.col("popularity_score") * pop_weight).alias("bias"))
    items = cut(encode(pool.select("query"), "query", "vec").join(pop, "query").join(held, "query", "left"))

    def full_scores(pairs: DataFrame) -> DataFrame:
        j = pairs.join(te, "prefix").join(items.withColumnRenamed("query", "candidate"), "candidate")
        mine = F.filter("asked", lambda x: F.array_contains("buckets", x["bucket"]))
        sparse = F.coalesce(F.col("w") * F.aggregate(mine, F.lit(0.0), lambda s, x: s + x["hs"]), F.lit(0.0))
        return j.select("prefix", "candidate",
                        F.round(D.dot("h", "vec") + sparse + F.col("bias"), 6).alias("hybrid_score"))

    near = cut(D.block_topk(te.select("prefix", F.col("h").alias("vec")), items, k, "dot",
                            probe_key="prefix", item_key="query", bias="bias")
               .select("prefix", F.col("query").alias("candidate"), F.col("score").alias("near"), "rank"))
    first = cut(full_scores(near.select("prefix", "candidate")))
    theta = (topk_per_key(first, "prefix", "hybrid_score", k).where(F.col("rank") == k)
             .select("prefix", F.col("hybrid_score").alias("theta")))
    # a prefix with fewer than k queries near it has met the whole pool already
    lift = (near.where(F.col("rank") == k).select("prefix", "near").join(theta, "prefix")
            .select("prefix", (F.col("theta") - F.col("near") - 2e-6).alias("lift")))
    blocks = cut(weights.groupBy("bucket", "w").agg(F.count(F.lit(1)).alias("size")))
    able = F.lit(not prune) | (F.col("w") * F.col("onward") >= F.col("lift"))
    read = qw.join(lift, "prefix").join(blocks, "bucket").where(able).select("prefix", "bucket", "w")
    pairs = cut(read.join(weights, ["bucket", "w"]).select("prefix", F.col("query").alias("candidate")).distinct())
    rest = full_scores(pairs.join(first.select("prefix", "candidate"), ["prefix", "candidate"], "left_anti"))
    return topk_per_key(first.unionByName(rest), "prefix", "hybrid_score", k)


def hybrid_lists(top: DataFrame, test: DataFrame) -> DataFrame:
    """``(prefix, retrieved_queries)`` for every test row: its ranked list, empty for a null
    prefix."""
    lists = collect_ranked_list(top, "prefix")
    return test.select("prefix").join(lists, "prefix", "left").select(
        F.coalesce("prefix", F.lit("")).alias("prefix"),
        F.coalesce("retrieved_queries", F.array().cast("array<string>")).alias("retrieved_queries"))
