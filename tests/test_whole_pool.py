"""U1, R6 and H4 are registered over the whole pool and the whole cascade."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """900 parts of different names, every fourth sold twice."""
    d = str(tmp_path_factory.mktemp("whole"))
    part = spark.range(1, 901).select(
        (F.col("id") * 4 + 2).alias("p_partkey"),
        F.concat(F.lit("item "), F.substring(F.md5(F.col("id").cast("string")), 1, 9)).alias("p_name"),
        F.lit("STEEL").alias("p_type"), F.lit("Brand#11").alias("p_brand"))
    part.write.parquet(f"{d}/part.parquet")
    spark.range(450).select(
        F.col("id").alias("l_orderkey"), ((F.col("id") % 225) * 16 + 6).alias("l_partkey"),
        F.lit(2.0).alias("l_quantity"), F.lit("R").alias("l_returnflag")).write.parquet(f"{d}/lineitem.parquet")
    return d


def _query(spark, name, d):
    from typeahead.plans import registry
    registry.load_all()
    return registry.QUERIES[name](spark, d)


def test_popular_subset_is_the_whole_pool(spark, tables):
    assert _query(spark, "fuzzy_popular_subset", tables).count() == 900


def test_reduced_pool_keeps_a_pool_below_its_sizes(spark, tables):
    assert _query(spark, "reduce_pool", tables).count() == 900


def test_backfill_is_of_the_cascade(spark, tables):
    """The cascade's lists are full before the back-fill, unlike lists of history alone."""
    lists = {r.prefix_clean: r.n for r in
             _query(spark, "collect_ranked_list", tables).select("prefix_clean", F.col("n_items").alias("n")).collect()}
    assert set(lists.values()) == {150}
    assert _query(spark, "backfill_random", tables).count() == 0
