"""Aggregations and profiling.

Every profile is one pass of grouped aggregates with map-side partial
aggregation.  Multi-column statistics unpivot with ``stack`` and group by the
column name, so adding columns adds rows, not passes.  Quantiles are exact and
come from ``ranking.quantiles``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .ranking import quantiles


def prefix_query_freq(train: DataFrame) -> DataFrame:
    """G1: count of each normalised query per normalised prefix."""
    t = train.select(normalize_text("prefix").alias("prefix_clean"),
                     normalize_text("query").alias("query_clean"))
    return t.groupBy("prefix_clean", "query_clean").agg(F.count(F.lit(1)).alias("freq"))


def mean_queries_per_prefix(train: DataFrame) -> DataFrame:
    """Distinct normalised prefixes and mean rows per prefix."""
    per = train.groupBy(normalize_text("prefix").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_prefixes"), F.avg("n").alias("mean_queries"))


def value_counts_topn(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent non-null values of a column."""
    c = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
         .agg(F.count(F.lit(1)).alias("n")))
    return c.orderBy(F.col("n").desc(), F.col("value").asc()).limit(n)


def distinct_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct non-null values per (table, column)."""
    parts = [df.agg(F.countDistinct(col).cast("bigint").alias("n_distinct"))
             .select(F.lit(name).alias("table_name"), F.lit(col).alias("column_name"), "n_distinct")
             for name, (df, col) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def null_counts(df: DataFrame, table_name: str) -> DataFrame:
    """Nulls per column, all columns in one pass."""
    row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    stack = "stack({}, {}) AS (column_name, n_null)".format(
        len(df.columns), ", ".join(f"'{c}', `{c}`" for c in df.columns))
    return row.selectExpr(stack).select(F.lit(table_name).alias("table_name"), "column_name",
                                        F.coalesce("n_null", F.lit(0)).cast("bigint").alias("n_null"))


def unpivot(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    stack = "stack({}, {}) AS (column_name, value)".format(
        len(cols), ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols))
    return df.selectExpr(*[f"`{k}`" for k in keep], stack)


def describe_long(long_df: DataFrame, group: list[str]) -> DataFrame:
    """G7 core over long form ``(group..., value)``: count, mean, sample std,
    min, quartiles (linear interpolation), max."""
    q = quantiles(long_df, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, group, [
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max")])
    return q.select(*group, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Describe every numeric column, one row per column."""
    return describe_long(unpivot(df, cols), ["column_name"])


def describe_by_class(df: DataFrame, cols: list[str], label: str = "target") -> DataFrame:
    """G7 per label value."""
    return describe_long(unpivot(df, cols, [label]), [label, "column_name"])


def length_stats(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, min, max of string length (nulls ignored)."""
    ln = F.length(col)
    return df.agg(F.avg(ln).alias("mean_len"), F.median(ln).alias("median_len"),
                  F.min(ln).cast("bigint").alias("min_len"), F.max(ln).cast("bigint").alias("max_len"))


def histogram(df: DataFrame, col: str, bins: int = 50, group: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the min and max of each group.

    Bin ``least(floor((x-min)·bins/(max-min)), bins-1)``; a constant group
    falls into bin 0.  Min/max come from a grouped aggregate joined back on
    the group key (one row per group), not a global sort.
    """
    group = group or []
    v = df.where(F.col(col).isNotNull()).select(*group, F.col(col).cast("double").alias("x"))
    if group:
        mm = v.groupBy(*group).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        v = v.join(mm, group)
    else:
        lo, hi = v.agg(F.min("x"), F.max("x")).first()
        v = v.withColumn("lo", F.lit(lo)).withColumn("hi", F.lit(hi))
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))),
                       F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    h = v.groupBy(*group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"),
                                               F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    return h.select(*group, "bin", "n", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"))


def feature_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation for every column pair, one aggregate, long form."""
    pairs = [(a, b) for a in cols for b in cols]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stack = "stack({}, {}) AS (col_a, col_b, corr)".format(
        len(pairs), ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs))
    return row.selectExpr(stack)


def join_match_rate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Share of left rows whose key has a match on the right."""
    r = right.select(key).distinct().withColumn("_hit", F.lit(1))
    j = left.select(key).join(r, key, "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.coalesce("_hit", F.lit(0))).cast("bigint").alias("n_matched"),
                 F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("match_rate"))


def gram_counts(texts: DataFrame, grams_col) -> DataFrame:
    """Count of each gram over all texts (map-side combined)."""
    return (texts.select(F.explode(grams_col).alias("gram"))
            .groupBy("gram").agg(F.count(F.lit(1)).alias("n")))


def label_balance(df: DataFrame, label: str = "target", extra_distinct: list[str] | None = None) -> DataFrame:
    """Totals, positives, negatives, shares, distinct counts."""
    aggs = [F.count(F.lit(1)).alias("n_total"),
            F.sum((F.col(label) == 1).cast("long")).alias("n_pos"),
            F.sum((F.col(label) == 0).cast("long")).alias("n_neg")]
    aggs += [F.countDistinct(c).alias(f"n_distinct_{c}") for c in (extra_distinct or [])]
    r = df.agg(*aggs)
    return r.withColumn("pos_share", F.col("n_pos") / F.col("n_total")) \
            .withColumn("neg_share", F.col("n_neg") / F.col("n_total"))


def unique_key_check(df: DataFrame, key: str) -> DataFrame:
    """Keys occurring more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)

