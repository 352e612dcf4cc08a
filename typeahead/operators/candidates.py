"""Candidate-table joins.

All of these are equi-joins on ``prefix`` / ``(prefix, candidate)`` /
``(prefix, rank)``; per-prefix values such as "max distance of this prefix"
are window aggregates partitioned by prefix, whose groups are bounded by the
top-k that produced them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text


def _empty():
    return F.array().cast("array<string>")


def guard_empty_prefix(test: DataFrame, lists: DataFrame, key_col: str = "prefix_clean",
                       key_fn=normalize_text, list_col: str = "retrieved_queries") -> DataFrame:
    """Every test row comes out; null/'' prefixes as ``('', [])`` and
    prefixes without candidates with ``[]``."""
    t = test.select(F.coalesce(F.col("prefix"), F.lit("")).alias("prefix"))
    t = t.withColumn("_k", F.when(F.col("prefix") == "", F.lit(None)).otherwise(key_fn(F.col("prefix"))))
    j = t.join(lists.withColumnRenamed(key_col, "_k"), "_k", "left")
    return j.select("prefix", F.coalesce(F.col(list_col), _empty()).alias(list_col))


def candidate_union(bm25: DataFrame, dense: DataFrame, default_distance: float = 1000.0) -> DataFrame:
    """BM25 FULL OUTER dense candidates per prefix.

    Missing BM25 score -> 0; missing distance -> the max distance of that
    prefix's dense candidates, else ``default_distance``.
    """
    j = (bm25.select("prefix", "candidate", "bm25_score")
         .join(dense.select("prefix", "candidate", "semantic_distance"), ["prefix", "candidate"], "full_outer"))
    w = Window.partitionBy("prefix")
    return j.select("prefix", "candidate",
                    F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"),
                    F.coalesce("semantic_distance", F.max("semantic_distance").over(w),
                               F.lit(default_distance)).alias("semantic_distance"))


def popularity_lookup(cands: DataFrame, features: DataFrame, cols: list[str],
                      key: str = "candidate", prefix: str = "popularity_") -> DataFrame:
    """Candidate -> popularity columns (renamed), zeros when absent."""
    f = features.select(F.col("query").alias(key), *[F.col(c).alias(prefix + c) for c in cols])
    return cands.join(f, key, "left").na.fill(0, [prefix + c for c in cols])


def history_lookup(test: DataFrame, history: DataFrame) -> DataFrame:
    """Test prefix -> historical queries with counts (inner equi-join)."""
    t = test.select("prefix", normalize_text("prefix").alias("prefix_clean"))
    return t.join(history, "prefix_clean")


def key_coverage(test: DataFrame, keys: DataFrame, key: str = "prefix_clean") -> DataFrame:
    """Share of test rows whose normalised prefix is a key of ``keys``."""
    t = test.select(normalize_text("prefix").alias(key))
    k = keys.select(key).distinct().withColumn("_hit", F.lit(1))
    j = t.join(k, key, "left")
    return j.agg(F.count(F.lit(1)).alias("n_test"),
                 F.sum(F.coalesce("_hit", F.lit(0))).cast("bigint").alias("n_covered"),
                 F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("coverage"))


def missing_prefixes(expected: DataFrame, output: DataFrame, col: str = "prefix") -> DataFrame:
    """Expected prefixes absent from the output (anti-join on distinct keys)."""
    return expected.select(col).distinct().join(output.select(col).distinct(), col, "left_anti")


def ensure_true_query(cands: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``(prefix, true query)`` with scores (0, 0) where retrieval missed it."""
    truth = pairs.select("prefix", F.col("query").alias("candidate")).distinct()
    miss = truth.join(cands.select("prefix", "candidate"), ["prefix", "candidate"], "left_anti")
    return cands.unionByName(miss.select("prefix", "candidate", F.lit(0.0).alias("bm25_score"),
                                         F.lit(0.0).alias("semantic_distance")))


def compare_methods(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rank-aligned lists of two methods per prefix with an overlap mark.

    Inputs are ranked ``(prefix, candidate, rank)``; output has one row per
    ``(prefix, rank)`` present on either side.
    """
    ka = a.select("prefix", "candidate").withColumn("_in_a", F.lit(1))
    kb = b.select("prefix", "candidate").withColumn("_in_b", F.lit(1))
    la = a.select("prefix", "rank", F.col("candidate").alias("candidate_a")) \
        .join(kb.withColumnRenamed("candidate", "candidate_a"), ["prefix", "candidate_a"], "left")
    lb = b.select("prefix", "rank", F.col("candidate").alias("candidate_b")) \
        .join(ka.withColumnRenamed("candidate", "candidate_b"), ["prefix", "candidate_b"], "left")
    j = la.join(lb, ["prefix", "rank"], "full_outer")
    return j.select("prefix", "rank", "candidate_a", "candidate_b",
                    F.coalesce("_in_b", F.lit(0)).alias("a_in_b"),
                    F.coalesce("_in_a", F.lit(0)).alias("b_in_a"))


def compare_methods_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per prefix, overlap size and candidates unique to each side."""
    j = (a.select("prefix", "candidate", F.lit(1).alias("_a"))
         .join(b.select("prefix", "candidate", F.lit(1).alias("_b")), ["prefix", "candidate"], "full_outer"))
    return j.groupBy("prefix").agg(
        F.sum((F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("long")).alias("n_both"),
        F.sum((F.col("_a").isNotNull() & F.col("_b").isNull()).cast("long")).alias("n_only_a"),
        F.sum((F.col("_a").isNull() & F.col("_b").isNotNull()).cast("long")).alias("n_only_b"))
