"""Running sums, quantiles and large top-n without a one-task sort.

Quantiles come from a sketch that brackets each rank and a count inside the brackets.
For the others rows are range-partitioned on the order columns and written to the checkpoint folder, so
their range buckets stay the same however often they are read.  A count or sum per bucket
(one row each) gives the offset of every bucket; inside a bucket a window does the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, reuse

_BEFORE = (Window.unboundedPreceding, -1)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the key columns of ``left`` stay."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    return left.join(r, on, how).drop(*[f"_r_{c}" for c in keys])


def _buckets(df: DataFrame, order: list[Column]) -> DataFrame:
    return cut(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))


def running_sums(df: DataFrame, order_col: str, cols: list[str], descending: bool = False,
                 group: list[str] | None = None) -> DataFrame:
    """Adds ``cum_<c>``, the inclusive running sum of each column over ``order_col``
    (one row per distinct value in a group)."""
    group = group or []
    by = F.col(order_col).desc() if descending else F.col(order_col).asc()
    s = _buckets(df, [*[F.col(g) for g in group], by])
    tot = s.groupBy(*group, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wb = Window.partitionBy(*group).orderBy("_b").rowsBetween(*_BEFORE)
    off = tot.select(*group, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in cols])
    w = Window.partitionBy(*group, "_b").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = join_null_safe(s, off, [*group, "_b"])
    out = out.select("*", *[(F.col(f"_o_{c}") + F.sum(c).over(w)).alias(f"cum_{c}") for c in cols])
    return out.drop("_b", *[f"_o_{c}" for c in cols])


ACCURACY = 10_000  # the sketch finds a rank to within 1 / ACCURACY of all rows


def quantiles(df: DataFrame, value: str, probs: dict[str, float], group: list[str],
              extra: list[Column] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, a column per entry of
    ``probs`` and the aggregates ``extra`` over the same rows.

    Two passes, no sort of the column.  The first takes a sketch per group, which brackets
    every wanted rank between two values.  The second counts the rows below a bracket and the
    rows of each value inside it (equal values are one row), and only those few are ranked.
    Null values are left out; a group of nulls alone gives no row; null groups are a group.
    """
    v = reuse(df.where(F.col(value).isNotNull()))
    # beyond the sketch's error, and a rank for the interpolation's neighbour
    slack = 3.0 / ACCURACY
    ends = [e for p in probs.values() for e in (max(0.0, p - slack), min(1.0, p + slack))]
    first = v.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"), F.percentile_approx(value, ends, ACCURACY).alias("_ends"),
                                  F.array(F.min(value), F.max(value)).alias("_range"), *(extra or []))
    # in a group with fewer rows than the sketch tells apart, all values are inside
    first = cut(first.withColumn("_ends", F.when(F.col("_size") > ACCURACY, F.col("_ends")).otherwise(
        F.flatten(F.array_repeat("_range", len(probs))))).drop("_range"))
    near = join_null_safe(v.select(*group, F.col(value).alias("_v")), first.select(*group, "_ends"), group)
    near = near.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(probs) - 1))))
    lo, hi = F.element_at("_ends", 2 * F.col("_i") + 1), F.element_at("_ends", 2 * F.col("_i") + 2)
    inside = (near.where(F.col("_v") <= hi).withColumn("_v", F.when(F.col("_v") >= lo, F.col("_v")))
              .groupBy(*group, "_i", "_v").agg(F.count(F.lit(1)).alias("_n")))
    upto = Window.partitionBy(*group, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    r = join_null_safe(inside.withColumn("_last", F.sum("_n").over(upto) - 1), first.select(*group, "_size"), group)

    picks, out = [], []
    for i, (k, p) in enumerate(probs.items()):
        at = (F.col("_size") - 1) * p
        for side, rank in (("l", F.floor(at)), ("h", F.ceil(at))):
            hit = (F.col("_i") == i) & (F.col("_last") - F.col("_n") < rank) & (rank <= F.col("_last"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{k}"))
        out.append((F.col(f"_l_{k}") + (at - F.floor(at)) * (F.col(f"_h_{k}") - F.col(f"_l_{k}"))).alias(k))
    r = join_null_safe(first.drop("_ends"), r.groupBy(*group).agg(*picks), group)
    return r.select(*[c for c in first.columns if c not in ("_size", "_ends")], *out)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows under a total order; for an ``n`` too large for one task."""
    s = _buckets(df, order)
    size = s.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    off = size.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(*_BEFORE)),
                                       F.lit(0)).alias("_o")).where(F.col("_o") < n)
    w = Window.partitionBy("_b").orderBy(*order)
    out = s.join(off, "_b").withColumn("_r", F.row_number().over(w) + F.col("_o"))
    return out.where(F.col("_r") <= n).drop("_b", "_o", "_r")
