"""Heuristic retrieval cascade (R8) and its coverage report.

One set-oriented job for all prefixes: after every stage the candidate count
per prefix decides which prefixes the next stage sees (only the "needy"
ones), and each stage adds only queries not listed yet.  Distinct normalised
prefixes are scored once and joined back to every test row, so duplicate
test rows keep their multiplicity and the raw prefix is what comes out.
Unlike the re-ranker's submission, this cascade has no empty-prefix guard:
a null or blank prefix normalises to '' and gets the history of '' plus the
popular fallback.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import fuzzy as FZ
from ..operators import popularity as P
from ..operators import prefix as R
from ..operators.profile import prefix_query_freq
from ..operators.topk import collect_ranked_list, topk_per_key
from ..session import cut, reuse

TOP_K = 150


class TrackA:
    """Tables of the cascade, each built when first used."""

    def __init__(self, train: DataFrame, pool: DataFrame, features: DataFrame, k: int, depth: int | None):
        self.inputs, self.k, self.depth = (train, pool, features), k, depth

    @cached_property
    def history(self) -> DataFrame:
        """prefix_clean, query_clean, freq"""
        return reuse(prefix_query_freq(self.inputs[0]))

    @cached_property
    def scored(self) -> DataFrame:
        """Pool rows: query, query_clean, popularity_score, popularity_norm."""
        return reuse(P.scored_pool(*self.inputs[1:]))

    @cached_property
    def popularity(self) -> DataFrame:
        """One row per query_clean."""
        return reuse(P.query_popularity(self.scored))

    @cached_property
    def index(self) -> DataFrame:
        """prefix_key, query_clean, popularity_norm, pos"""
        return reuse(R.prefix_index(self.popularity, self.k, self.depth))

    @cached_property
    def popular(self) -> DataFrame:
        """Queries for fuzzy matching: query_clean, popularity_score."""
        return reuse(FZ.fuzzy_popular_subset(self.scored))


def build(train: DataFrame, pool: DataFrame, features: DataFrame, test: DataFrame | None = None,
          k: int = TOP_K) -> TrackA:
    """``test`` bounds the depth of the prefix index by its longest prefix."""
    depth = None if test is None else test.agg(F.max(F.length(normalize_text("prefix")))).first()[0] or 0
    return TrackA(train, pool, features, k, depth)


def cascade_candidates(a: TrackA, prefixes: DataFrame, k: int = TOP_K,
                       fuzzy: str = "levenshtein") -> DataFrame:
    """Scored candidates ``(prefix_clean, query_clean, score, stage)`` of all stages."""
    # an empty normalised prefix is scored like any other (history of the
    # empty prefix, then the popular fallback), as the cascade does
    p = reuse(prefixes.select("prefix_clean").distinct())
    s1 = reuse(R.history_and_match(p, a.history, a.popularity, a.index, k).withColumn("stage", F.lit(1)))
    n1 = R.needy(p, s1, k)
    s2 = R.prefix_backoff(n1, s1, a.index, k).withColumn("stage", F.lit(2))
    c2 = reuse(s1.unionByName(s2))
    n2 = R.needy(p, c2, k)
    match = FZ.fuzzy_partial_ratio if fuzzy == "partial_ratio" else FZ.fuzzy_window_levenshtein
    fz = match(n2, a.popular, limit=k)
    fz = fz.join(a.popularity.select("query_clean", "popularity_norm"), "query_clean", "left")
    s3 = (fz.join(c2.select("prefix_clean", "query_clean"), ["prefix_clean", "query_clean"], "left_anti")
          .select("prefix_clean", "query_clean",
                  (F.col("fuzzy_score") / 100.0 * R.FUZZY_BASE
                   + F.coalesce("popularity_norm", F.lit(0.0)) * R.FUZZY_POP).alias("score"))
          .withColumn("stage", F.lit(3)))
    c3 = cut(c2.unionByName(s3))
    n3 = R.needy(p, c3, k)
    s4 = R.popularity_fallback(n3, c3, R.popular_list(a.scored, 2 * k), k).withColumn("stage", F.lit(4))
    return c3.unionByName(s4).withColumn("score", F.round("score", 6))


def rank_candidates(a: TrackA, candidates: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top ``k`` ranked rows per normalised prefix, back-filled to ``k`` (H4)."""
    c = candidates.withColumnRenamed("query_clean", "candidate")
    top = topk_per_key(c, "prefix_clean", "score", k).select(
        "prefix_clean", F.col("candidate").alias("query_clean"), "rank", "stage")
    fill = R.backfill_random(top, a.scored, k).withColumn("stage", F.lit(5))
    return top.unionByName(fill)


def cascade_ranked(a: TrackA, prefixes: DataFrame, k: int = TOP_K, fuzzy: str = "levenshtein") -> DataFrame:
    return rank_candidates(a, cascade_candidates(a, prefixes, k, fuzzy), k)


def submission(test: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(prefix, retrieved_queries)`` for every test row, from the ranked lists: its raw
    prefix (null as '') and its list (empty where there is none)."""
    t = test.select("prefix", normalize_text("prefix").alias("prefix_clean"))
    lists = collect_ranked_list(ranked.withColumnRenamed("query_clean", "candidate"), "prefix_clean")
    return t.join(lists, "prefix_clean", "left").select(
        F.coalesce("prefix", F.lit("")).alias("prefix"),
        F.coalesce("retrieved_queries", F.array().cast("array<string>")).alias("retrieved_queries"))


def cascade_topk(train: DataFrame, test: DataFrame, pool: DataFrame, features: DataFrame,
                 k: int = TOP_K, fuzzy: str = "levenshtein") -> DataFrame:
    """``(prefix, retrieved_queries)`` for every test row."""
    a = build(train, pool, features, test, k)
    prefixes = test.select(normalize_text("prefix").alias("prefix_clean"))
    return submission(test, cascade_ranked(a, prefixes, k, fuzzy))
