"""The four autocomplete input tables, derived from the driver's tables.

The engine's inputs are ``train(prefix, query)``, ``test_prefixes(prefix)``,
``query_features(query, orders, volume, catalog_clicks, catalog_views)`` and
``pool(query)``.  The test data ships TPC-H-like tables instead, so each
input is a plain derivation over ``part`` and ``lineitem`` (and ``labels`` for
scored rows).  Their size grows with the source tables.

``FX_SQL`` holds the same derivations as SQL text so the DuckDB oracle
queries start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _raw_query(p: DataFrame):
    """Raw query text built from a part row: stray spaces, mixed case, '#'."""
    k = (F.col("p_partkey") % 4).cast("int")
    return (F.when(k == 0, F.concat(F.lit("  "), F.col("p_name"), F.lit("   "), F.col("p_type")))
            .when(k == 1, F.concat(F.upper("p_name"), F.lit(" "), F.col("p_type"), F.lit(" "), F.col("p_brand")))
            .otherwise(F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" "), F.lower("p_brand"))))


def fx_pool(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select(_raw_query(p).alias("query")).distinct()


def fx_query_features(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    li = read_table(spark, d, "lineitem")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return (j.groupBy(_raw_query(p).alias("query"))
            .agg(F.countDistinct("l_orderkey").alias("orders"),
                 F.sum("l_quantity").alias("volume"),
                 F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("bigint").alias("catalog_clicks"),
                 F.count(F.lit(1)).alias("catalog_views")))


def fx_train(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    li = read_table(spark, d, "lineitem")
    j = li.join(p, li.l_partkey == p.p_partkey)
    q = _raw_query(p)
    prefix = F.substring(F.ltrim(F.lower(q)), F.lit(1), (F.lit(2) + F.col("l_orderkey") % 9).cast("int"))
    return j.select(F.when(F.col("l_orderkey") % 97 == 0, F.lit(None).cast("string"))
                    .otherwise(prefix).alias("prefix"), q.alias("query"))


def fx_test(spark: SparkSession, d: str) -> DataFrame:
    """Distinct test prefixes, one or two per part; every third part's
    prefix drops its second letter (a typo)."""
    p = read_table(spark, d, "part")
    base = F.ltrim(F.lower(_raw_query(p)))
    typo = F.concat(F.substring(base, 1, 1),
                    F.substring(base, F.lit(3), (F.lit(3) + F.col("p_partkey") % 6).cast("int")))
    plain = F.substring(base, F.lit(1), (F.lit(3) + F.col("p_partkey") % 10).cast("int"))
    return p.select(F.when(F.col("p_partkey") % 3 == 0, typo).otherwise(plain).alias("prefix")).distinct()


def fx_scored(spark: SparkSession, d: str) -> DataFrame:
    lab = read_table(spark, d, "labels")
    return lab.select("doc_id", F.col("quality").alias("target"),
                      (F.lit(0.3) * F.col("quality")
                       + F.lit(0.7) * ((F.col("doc_id") * 7919) % 1000) / F.lit(1000.0)).alias("score"))


# --- Same derivations as SQL text (DuckDB dialect; also valid Spark SQL). ---

_Q = ("CASE CAST(p_partkey % 4 AS INT) "
      "WHEN 0 THEN '  ' || p_name || '   ' || p_type "
      "WHEN 1 THEN upper(p_name) || ' ' || p_type || ' ' || p_brand "
      "ELSE p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) END")

FX_SQL = {
    "fx_pool": f"SELECT DISTINCT {_Q} AS query FROM part",
    "fx_query_features": (
        f"SELECT {_Q} AS query, CAST(COUNT(DISTINCT l_orderkey) AS BIGINT) AS orders, "
        "SUM(l_quantity) AS volume, "
        "CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS catalog_clicks, "
        "CAST(COUNT(*) AS BIGINT) AS catalog_views "
        "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "fx_train": (
        "SELECT CASE WHEN l_orderkey % 97 = 0 THEN NULL "
        f"ELSE substr(ltrim(lower({_Q})), 1, CAST(2 + l_orderkey % 9 AS INT)) END AS prefix, "
        f"{_Q} AS query FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "fx_test": (
        "SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 "
        f"THEN substr(ltrim(lower({_Q})), 1, 1) || substr(ltrim(lower({_Q})), 3, CAST(3 + p_partkey % 6 AS INT)) "
        f"ELSE substr(ltrim(lower({_Q})), 1, CAST(3 + p_partkey % 10 AS INT)) END AS prefix FROM part"),
    "fx_scored": ("SELECT doc_id, quality AS target, "
                  "0.3e0 * quality + 0.7e0 * ((doc_id * 7919) % 1000) / 1000e0 AS score FROM labels"),
}


def with_fx(*names: str) -> str:
    """``WITH`` clause defining the named fixture views, for oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({FX_SQL[n]})" for n in names) + "\n"


def inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The four engine inputs for a test-data folder."""
    return {"train": fx_train(spark, d), "test": fx_test(spark, d),
            "features": fx_query_features(spark, d), "pool": fx_pool(spark, d)}
