"""Ranking, top-k, lists and set operations.

Top-k per key is ``row_number() <= k`` over a window; Spark rewrites this
into a ``WindowGroupLimit`` that also runs *before* the shuffle, so each map
task ships at most k rows per key no matter how hot the key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_n


def _order(score: str, tie: str, ascending: bool) -> list[Column]:
    s = F.col(score).asc() if ascending else F.col(score).desc()
    return [s, F.col(tie).asc()]


def topk_per_key(df: DataFrame, key: str | list[str], score: str, k: int,
                 tie: str = "candidate", ascending: bool = False,
                 rank_col: str = "rank") -> DataFrame:
    """Best ``k`` rows per key by ``score`` (ties by ``tie`` ascending)."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*_order(score, tie, ascending))
    return (df.withColumn(rank_col, F.row_number().over(w))
            .where(F.col(rank_col) <= k))


def collect_ranked_list(df: DataFrame, key: str, item: str = "candidate",
                        rank_col: str = "rank", out: str = "retrieved_queries") -> DataFrame:
    """Ranked rows -> one ordered array per key.

    Input rows per key are already bounded by a top-k, so the list is bounded.
    """
    return (df.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"),
                                                      F.col(item).alias("v")))).alias("_l"))
            .select(key, F.transform("_l", lambda x: x["v"]).alias(out)))


def head_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First ``n`` rows under a total order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def cap_postings(df: DataFrame, key: str, m: int, order: list[Column],
                 pos_col: str = "pos") -> DataFrame:
    """At most ``m`` rows per key under ``order``; ``pos`` is 1-based."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(pos_col, F.row_number().over(w)).where(F.col(pos_col) <= m)


def distinct_queries(df: DataFrame, col: str = "query_clean") -> DataFrame:
    """Unique values of one column."""
    return df.select(col).distinct()


def method_set_ops(a: DataFrame, b: DataFrame, key: str = "prefix",
                   la: str = "list_a", lb: str = "list_b") -> DataFrame:
    """Per key, intersection and both differences of two lists."""
    j = a.join(b, key, "full_outer")
    ea = F.coalesce(F.col(la), F.array().cast("array<string>"))
    eb = F.coalesce(F.col(lb), F.array().cast("array<string>"))
    return j.select(key, F.array_intersect(ea, eb).alias("both"),
                    F.array_except(ea, eb).alias("only_a"),
                    F.array_except(eb, ea).alias("only_b"))


def reduce_pool(pool: DataFrame, score: str, n_top: int, n_random: int,
                seed: int = 42, key: str = "query_clean") -> DataFrame:
    """The ``n_top`` most popular rows plus a fixed-seed sample of
    ``n_random`` rows, exact duplicates removed.

    The sample order is ``md5(seed|key)`` so it is the same on every run.
    """
    top = top_n(pool, [F.col(score).desc(), F.col(key).asc()], n_top)
    rnd = fixed_size_sample(pool, n_random, seed, key)
    return top.unionByName(rnd).dropDuplicates()


def fixed_size_sample(df: DataFrame, n: int, seed: int = 42, key: str = "query") -> DataFrame:
    """H1: ``n`` rows chosen by a seeded hash order (deterministic)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return top_n(df.withColumn("_h", h), [F.col("_h").asc(), F.col(key).asc()], n).drop("_h")
