"""Popularity scoring (P1-P5) and pool enrichment joins.

Normalising by a global maximum needs one scalar; it comes from a one-row
aggregate and is inlined as a literal, so the per-row work stays a plain
projection with no join at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..session import reuse

FEATURES = ["orders", "volume", "catalog_clicks", "catalog_views"]

# Weights of the linear popularity score.
LINEAR_WEIGHTS = {"orders": 10.0, "volume": 5.0, "catalog_clicks": 2.0, "catalog_views": 1.0}
# Weights of the max-normalised popularity score.
WEIGHTED = {"orders": 0.4, "catalog_clicks": 0.3, "volume": 0.2, "catalog_views": 0.1}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal", "byte")]


def fill_missing_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric nulls -> 0 (string columns are left alone)."""
    return df.na.fill(0, subset=cols or numeric_columns(df))


def enrich_pool_normalized(pool: DataFrame, features: DataFrame) -> DataFrame:
    """Pool LEFT JOIN features on the normalised query (may fan out)."""
    p = pool.select("query", normalize_text("query").alias("query_clean"))
    f = features.select(normalize_text("query").alias("query_clean"), *FEATURES)
    return p.join(f, "query_clean", "left")


def enrich_pool_raw(pool: DataFrame, features: DataFrame) -> DataFrame:
    """Pool LEFT JOIN features on the raw query text."""
    return pool.select("query").join(features.select("query", *FEATURES), "query", "left")


def popularity_linear(df: DataFrame) -> DataFrame:
    """``10·orders + 5·volume + 2·clicks + views``."""
    expr = sum(F.col(c) * F.lit(w) for c, w in LINEAR_WEIGHTS.items())
    return df.withColumn("popularity_score", expr.cast("double"))


def _max_norm(col: str, mx) -> "F.Column":
    return F.col(col) / F.lit(float(mx)) if mx is not None and mx > 0 else F.lit(0.0)


def popularity_max_norm(df: DataFrame, score: str = "popularity_score",
                        out: str = "popularity_norm") -> DataFrame:
    """Score / global max, 0 when the max is not positive."""
    mx = df.agg(F.max(score)).first()[0]
    return df.withColumn(out, _max_norm(score, mx))


def feature_max_norm(df: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """Each feature / its max (one aggregate for all columns)."""
    row = df.agg(*[F.max(c).alias(c) for c in cols]).first()
    for c in cols:
        df = df.withColumn(f"{c}_norm", _max_norm(c, row[c]))
    return df


def popularity_weighted(df: DataFrame) -> DataFrame:
    """``0.4·orders_n + 0.3·clicks_n + 0.2·volume_n + 0.1·views_n``."""
    expr = sum(F.col(f"{c}_norm") * F.lit(w) for c, w in WEIGHTED.items())
    return df.withColumn("popularity_score", expr)


def top_popular(df: DataFrame, n: int, score: str = "popularity_score",
                key: str = "query_clean") -> DataFrame:
    """P5: the ``n`` most popular rows (ties by key), a TakeOrderedAndProject."""
    return df.orderBy(F.col(score).desc(), F.col(key).asc()).limit(n)


def scored_pool(pool: DataFrame, features: DataFrame) -> DataFrame:
    """Track A pool: J1 -> T8 -> P1 -> P2, pruned to the columns used later."""
    # kept, as the maximum reads the rows too: the features are summed once
    e = reuse(fill_missing_zero(enrich_pool_normalized(pool, features), FEATURES))
    s = popularity_max_norm(popularity_linear(e))
    return s.select("query", "query_clean", "popularity_score", "popularity_norm")


def query_popularity(scored: DataFrame) -> DataFrame:
    """One row per normalised query with its max popularity (lookup table)."""
    return (scored.groupBy("query_clean")
            .agg(F.max("popularity_score").alias("popularity_score"),
                 F.max("popularity_norm").alias("popularity_norm")))


def hybrid_pool_popularity(pool: DataFrame, features: DataFrame) -> DataFrame:
    """Track B pool popularity: J2 -> T8 -> P3 -> P4."""
    e = fill_missing_zero(enrich_pool_raw(pool, features), FEATURES)
    return popularity_weighted(feature_max_norm(e))
