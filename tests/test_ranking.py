"""Running sums, quantiles, large top-n, repeated rows and splits against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeahead.operators import evaluate as E
from typeahead.operators import features as FT
from typeahead.operators.ranking import quantiles, running_sums, top_n
from typeahead.session import release, reuse


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    g = [["a", "b", None][i] for i in rng.integers(0, 3, 600)]
    v = [float(x) for x in rng.integers(0, 90, 600)]
    return spark.createDataFrame(list(zip(g, v, range(600))), "g string, v double, id int"), g, v


def test_quantiles_match_numpy(rows):
    df, g, v = rows
    got = {r.g: (r.p25, r.p50) for r in quantiles(df, "v", {"p25": 0.25, "p50": 0.5}, ["g"]).collect()}
    for k in ("a", "b", None):
        x = [b for a, b in zip(g, v) if a == k]
        assert np.allclose(got[k], np.percentile(x, [25, 50]))


def test_running_sums_and_top_n(rows):
    df, _, v = rows
    c = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.v: r.cum_n for r in running_sums(c, "v", ["n"], descending=True).collect()}
    assert got == {x: sum(1 for y in v if y >= x) for x in set(v)}
    order = [F.col("v").desc(), F.col("id").asc()]
    want = sorted(range(600), key=lambda i: (-v[i], i))
    assert {r.id for r in top_n(df, order, 250).collect()} == set(want[:250])
    assert top_n(df, order, 1000).count() == 600


def test_empty_input(spark):
    e = spark.createDataFrame([], "target int, score double")
    assert E.roc_auc(e).first()["auc"] is None
    assert E.roc_curve(e).count() == E.probability_distribution(e).count() == 0
    assert top_n(e, [F.col("score").asc()], 3).count() == 0


def test_split_is_stratified(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 37, 1).when(F.col("id") < 990, 0).alias("target"))
    got = {(r.target, r.is_valid): r["count"] for r in
           FT.stratified_split(df, "id").groupBy("target", "is_valid").count().collect()}
    assert [got[t, True] for t in (1, 0, None)] == [7, 191, 2]
    assert sum(got.values()) == 1000


def test_occurrences_number_every_repetition(spark):
    df = spark.range(25).select(F.when(F.col("id") < 23, "hot").otherwise("cold").alias("prefix"),
                                F.lit("q").alias("query"))
    got = sorted((r.prefix, r.occ) for r in FT.occurrences(df, ["prefix", "query"], step=4).collect())
    assert got == [("cold", 0), ("cold", 1)] + [("hot", i) for i in range(23)]


def test_release_keeps_other_caches(spark):
    own, other = reuse(spark.range(3)), spark.range(4).withColumn("x", F.lit(1)).cache()
    release()
    assert own.storageLevel.useMemory is False and other.storageLevel.useMemory is True
    other.unpersist()


@pytest.mark.parametrize("n", [1, 2, 58, 30_000])
def test_quantiles_at_every_size(spark, n):
    """Fewer rows than the sketch tells apart, and more; a third of the rows share a value."""
    import numpy as np
    x = np.where(np.arange(n) % 3 == 0, 0.5, np.random.default_rng(n).normal(size=n).round(4))
    df = spark.range(n).selectExpr("id", "CAST(NULL AS STRING) AS g")
    df = df.join(spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(x)], "id long, v double"), "id")
    probs = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    got = quantiles(df, "v", probs, ["g"]).first()
    assert got.g is None and all(abs(got[k] - np.quantile(x, p)) < 1e-9 for k, p in probs.items())


def test_negatives_draw_without_a_window_over_repetitions(spark):
    """Repeated pairs draw row by row, as a plain loop does; counts agree with the rows."""
    import hashlib

    from pyspark.sql import functions as F

    from typeahead.operators import features as FT

    def number(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)

    cands = [("a", f"q{i}") for i in range(30)] + [("b", f"q{i}") for i in range(4)] + [("c", "q1"), ("a", None), ("d", "q1"), ("d", "q1")]
    counted = [("a", "q3", 40), ("a", "q99", 3), ("b", "q2", 5), ("b", None, 2), ("c", "q1", 4), ("c", "q2", 2),
               ("d", "q1", 3), ("none", "q1", 2), (None, "q1", 2)]
    want = []
    for prefix, query, n in counted:
        own = sorted((c for p, c in cands if p == prefix),
                     key=lambda c: (hashlib.md5("|".join(["42", prefix] + [c] * (c is not None)).encode()).hexdigest(), c or ""))
        for occ in range(n if own and query else 0):
            key = f"42|{prefix}|{query}|{occ}"
            start = number(key + "|start") % len(own)
            run = [own[(start + j) % len(own)] for j in range(min(11, len(own)))]
            want += [(prefix, query, occ, c) for c in [c for c in run if c not in (None, query)][:5 + number(key) % 6]]
    pairs = spark.createDataFrame(counted, "prefix string, query string, n long")
    c = spark.createDataFrame(cands, "prefix string, candidate string")
    got = FT.sample_negatives(pairs, c, repeats="n")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    met, drew = FT.count_negatives(pairs, c, "n")
    by_rows = got.groupBy("prefix", "candidate").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(met.collect()) == sorted(by_rows.collect())
    assert sorted(map(tuple, drew.collect())) == sorted({r[:2] for r in want})


def test_scored_pool_sums_the_features_once(spark):
    """The maximum and the rows come from one evaluation of the feature table."""
    from typeahead.operators.popularity import scored_pool

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = [("Red Lamp", 3, 2.0, 1, 4), ("blue lamp", 1, 1.0, 0, 2), ("x", 0, 0.0, 0, 0)]
    features = spark.createDataFrame(rows, "query string, orders long, volume double, catalog_clicks long, catalog_views long")
    features = features.withColumn("query", seen("query"))
    pool = spark.createDataFrame([("Red Lamp",), ("blue lamp",), ("none",)], "query string")
    got = {r["query"]: (r.popularity_score, r.popularity_norm) for r in scored_pool(pool, features).collect()}
    assert got == {"Red Lamp": (46.0, 1.0), "blue lamp": (17.0, 17 / 46), "none": (0.0, 0.0)}
    assert read.value == 3
    release()
