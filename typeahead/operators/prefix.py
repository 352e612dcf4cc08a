"""Prefix, back-off, fallback and back-fill retrieval.

The prefix index is an explode of each distinct query into its first characters
(as many as the longest prefix to look up has), so "queries starting with p"
becomes an equi-join on the key instead of a ``startswith`` nested loop.  A list
of k queries never needs more than the 2k most popular postings of a key (k new
ones after at most k already listed), so posting lists end there, with a
``WindowGroupLimit`` that shortens hot one-letter keys *before* the shuffle.

Lists that every needy prefix shares (the popular list, the back-fill slice)
are bounded by a parameter (2k rows) and attached by an equi-join on the
list rank: each prefix expands to ``sequence(1, m)`` and picks entry ``r``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topk import cap_postings

# Fixed values of the heuristic cascade.
HISTORY_WEIGHT = 100.0
MATCH_BASE, MATCH_POP = 50.0, 20.0
BACKOFF_BASE, BACKOFF_POP = 25.0, 10.0
FUZZY_BASE, FUZZY_POP = 30.0, 10.0
FALLBACK_POP = 5.0


def prefix_index(popularity: DataFrame, k: int, depth: int | None = None) -> DataFrame:
    """``(prefix_key, query_clean, popularity_norm, pos)``.

    ``popularity`` has one row per ``query_clean``.  Every prefix of length
    1..depth of each query is a key (``depth``: the longest prefix that will be
    looked up, None: all); each key keeps its ``2k`` most popular queries (ties
    by text), ``pos`` 1-based in that order.
    """
    q = popularity.where(F.length("query_clean") > 0)
    n = F.length("query_clean") if depth is None else F.least(F.length("query_clean"), F.lit(depth))
    e = q.where(n > 0).select("query_clean", "popularity_norm", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    e = e.select(F.expr("substring(query_clean, 1, i)").alias("prefix_key"), "query_clean", "popularity_norm")
    return cap_postings(e, "prefix_key", 2 * k, [F.col("popularity_norm").desc(), F.col("query_clean").asc()])


def history_scores(prefixes: DataFrame, history: DataFrame) -> DataFrame:
    """Stage 1a: ``100·freq`` for each query seen with the prefix in training."""
    return (prefixes.join(history, "prefix_clean")
            .select("prefix_clean", "query_clean", (F.col("freq") * HISTORY_WEIGHT).alias("score")))


def prefix_match(prefixes: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """R2: the first ``2k`` postings of the exact prefix, ``50 + 20·pop``."""
    post = index.where(F.col("pos") <= 2 * k).withColumnRenamed("prefix_key", "prefix_clean")
    return prefixes.join(post, "prefix_clean").select("prefix_clean", "query_clean", _match_score().alias("score"))


def _match_score():
    return F.lit(MATCH_BASE) + F.col("popularity_norm") * MATCH_POP


def history_and_match(prefixes: DataFrame, history: DataFrame, popularity: DataFrame, index: DataFrame,
                      k: int) -> DataFrame:
    """Stage 1: history and prefix scores added up.  A past query that starts with the
    prefix gets its prefix score however far down the posting list it stands."""
    past = history_scores(prefixes, history)
    starts = (past.drop("score").join(popularity.select("query_clean", "popularity_norm"), "query_clean")
              .where((F.length("prefix_clean") > 0) & F.col("query_clean").startswith(F.col("prefix_clean")))
              .select("prefix_clean", "query_clean", _match_score().alias("score")))
    match = prefix_match(prefixes, index, k).unionByName(starts).dropDuplicates(["prefix_clean", "query_clean"])
    return past.unionByName(match).groupBy("prefix_clean", "query_clean").agg(F.sum("score").alias("score"))


def stage_counts(cands: DataFrame) -> DataFrame:
    return cands.groupBy("prefix_clean").agg(F.count(F.lit(1)).alias("n_cands"))


def needy(prefixes: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """Prefixes with fewer than ``k`` candidates so far, with the count."""
    c = prefixes.join(stage_counts(cands), "prefix_clean", "left").na.fill(0, ["n_cands"])
    return c.where(F.col("n_cands") < k)


def prefix_backoff(needy_prefixes: DataFrame, cands: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Back off to shorter prefixes, down to length 2.

    A query takes the score of the longest level that lists it,
    ``25·i/len + 10·pop``, and only if it is not a candidate yet.  Level i
    is read only while the running count before it is below ``k``: counts
    per level are aggregated first (one row per prefix and level), then a running sum
    over levels picks the levels to keep.
    """
    p = needy_prefixes.where(F.length("prefix_clean") >= 2).select(
        "prefix_clean", "n_cands", F.length("prefix_clean").alias("plen"))
    lv = p.select("prefix_clean", "n_cands", "plen",
                  F.explode(F.sequence(F.col("plen"), F.lit(2), F.lit(-1))).alias("lvl"))
    lv = lv.withColumn("prefix_key", F.expr("substring(prefix_clean, 1, lvl)"))
    post = index.where(F.col("pos") <= 2 * k)
    hits = lv.join(post, "prefix_key")
    hits = hits.join(cands.select("prefix_clean", "query_clean"), ["prefix_clean", "query_clean"], "left_anti")
    first = Window.partitionBy("prefix_clean", "query_clean").orderBy(F.col("lvl").desc())
    hits = hits.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    per_level = hits.groupBy("prefix_clean", "lvl").agg(F.count(F.lit(1)).alias("n_new"),
                                                         F.first("n_cands").alias("n_cands"))
    w = Window.partitionBy("prefix_clean").orderBy(F.col("lvl").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_level = per_level.withColumn("before", F.col("n_cands") + F.coalesce(F.sum("n_new").over(w), F.lit(0)))
    keep = per_level.where(F.col("before") < k).select("prefix_clean", "lvl")
    return (hits.join(keep, ["prefix_clean", "lvl"])
            .select("prefix_clean", "query_clean",
                    (F.lit(BACKOFF_BASE) * F.col("lvl") / F.col("plen")
                     + F.col("popularity_norm") * BACKOFF_POP).alias("score")))


def ranked_list(df: DataFrame, n: int, order, name: str = "r") -> DataFrame:
    """First ``n`` rows of a bounded list under ``order`` with a 1-based rank.

    A global top-n (TakeOrderedAndProject) followed by ranking ``n`` rows.
    """
    top = df.orderBy(*order).limit(n)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def popular_list(popularity_rows: DataFrame, n: int) -> DataFrame:
    """R6-style: the ``n`` most popular pool rows, ranked (may repeat a query)."""
    return ranked_list(popularity_rows, n, [F.col("popularity_score").desc(), F.col("query_clean").asc(),
                                            F.col("query").asc()])


def popularity_fallback(needy_prefixes: DataFrame, cands: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """Popular queries not yet listed, ``5·pop``, until ``2k`` in total.

    ``popular`` is the ranked 2k-row list; each needy prefix expands to ranks
    1..2k (an equi-join on rank against the bounded list).
    """
    m = 2 * k
    e = needy_prefixes.select("prefix_clean", "n_cands", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("r"))
    j = e.join(popular.select("r", "query_clean", "popularity_norm"), "r")
    j = j.join(cands.select("prefix_clean", "query_clean"), ["prefix_clean", "query_clean"], "left_anti")
    first = Window.partitionBy("prefix_clean", "query_clean").orderBy("r")
    j = j.withColumn("_f", F.row_number().over(first)).where("_f = 1")
    order = Window.partitionBy("prefix_clean").orderBy("r")
    j = j.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.lit(m) - F.col("n_cands"))
    return j.select("prefix_clean", "query_clean", (F.col("popularity_norm") * FALLBACK_POP).alias("score"))


def backfill_random(lists: DataFrame, pool_queries: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """H4: fill ranked lists shorter than ``k`` with pool queries not yet listed.

    ``lists`` holds ranked rows ``(prefix_clean, query_clean, rank)``.  The
    fill order is ``md5(seed|query)``; the first 2k distinct queries of that
    order always hold enough new ones.  Output rows get ranks after the list.
    """
    counts = lists.groupBy("prefix_clean").agg(F.count(F.lit(1)).alias("n"))
    short = counts.where(F.col("n") < k)
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col("query_clean")))
    fill = ranked_list(pool_queries.select("query_clean").distinct().withColumn("h", h), 2 * k,
                       [F.col("h").asc(), F.col("query_clean").asc()], "fr")
    e = short.select("prefix_clean", "n", F.explode(F.sequence(F.lit(1), F.lit(2 * k))).alias("fr"))
    j = e.join(fill.select("fr", "query_clean"), "fr")
    j = j.join(lists.select("prefix_clean", "query_clean"), ["prefix_clean", "query_clean"], "left_anti")
    w = Window.partitionBy("prefix_clean").orderBy("fr")
    j = j.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= F.lit(k) - F.col("n"))
    return j.select("prefix_clean", "query_clean", (F.col("n") + F.col("_i")).cast("int").alias("rank"))
