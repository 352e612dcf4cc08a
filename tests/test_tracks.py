"""Encoder and tokenizer arguments, metrics per split, saved models and shared stage tables."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeahead import session
from typeahead.operators import dense as D
from typeahead.operators import evaluate as E
from typeahead.operators import popularity as P
from typeahead.plans import track_b as TB
from typeahead.plans import track_c as TC
from typeahead.session import cut, shared


def letters_model():
    """A model of its own: letter counts of each text (a closure, so that workers get it by value)."""
    def load():
        def predict(texts):
            return np.array([[t.lower().count(c) for c in "abcdefghij"] for t in texts], dtype=np.float32)
        return predict
    return load


load_letters = letters_model()


def letter_pairs(col):
    """A tokenizer of its own: words of exactly two letters or more, digits apart."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit("[a-z]{2,}|[0-9]"), 0)


def tables(spark):
    words = "ab cd ef gh ij abc def ghi jab 1 2 3 fab dab cab".split()
    pool = sorted({" ".join(words[(i * j + j * j) % len(words)] for j in range(1, 2 + i % 4)) for i in range(120)})
    pool_df = spark.createDataFrame([(q,) for q in pool], "query string")
    features = spark.createDataFrame([(q, i % 7, float(i % 5), i % 3, i) for i, q in enumerate(pool[::2])],
                                     "query string, orders long, volume double, catalog_clicks long, catalog_views long")
    prefixes = ["ab", "ab c", "fab 1", "zz", "", "ghi def 2", "j"]
    test = spark.createDataFrame([(p,) for p in prefixes + ["ab", None]], "prefix string")
    return pool, pool_df, features, prefixes, test


def test_hybrid_with_another_encoder_and_tokenizer(spark):
    import hashlib
    import re
    pool, pool_df, features, prefixes, test = tables(spark)
    encode = D.model_encoder(load_letters, batch_size=8)
    alpha, weight, k = 0.6, 0.15, 9
    top = TB.hybrid_topk(test, pool_df, features, k, alpha, weight, encode=encode, tokens=letter_pairs)
    got = {}
    for r in top.collect():
        got.setdefault(r.prefix, []).append((r["rank"], r.candidate, r.hybrid_score))

    def buckets(t):
        return {int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 2 ** 16 for w in re.findall("[a-z]{2,}|[0-9]", t)}
    vec = load_letters()
    x = vec(pool).astype(float)
    held = [buckets(q) for q in pool]
    avgdl = sum(map(len, held)) / len(pool)
    df = {b: sum(b in h for h in held) for h in held for b in h}
    w = [1 / (1.6 * (0.25 + 0.75 * len(h) / avgdl) + 1) for h in held]
    pop = {r["query"]: r["popularity_score"] for r in P.hybrid_pool_popularity(pool_df, features).collect()}
    for p in prefixes:
        idf = {b: np.log((len(pool) + 1) / (df.get(b, 0) + 0.5)) for b in buckets(p)}
        q = {b: v / sum(idf.values()) for b, v in idf.items()}
        norm = np.sqrt(sum(v * v for v in q.values())) + 1e-10
        h = vec([p])[0].astype(float)
        h = h / (np.sqrt((h * h).sum()) + 1e-10) * alpha
        want = sorted((-round(float(h @ x[i] + sum(q[b] / norm * (1 - alpha) * w[i] for b in q if b in held[i])
                                    + weight * pop[t]), 6) + 0.0, t) for i, t in enumerate(pool))[:k]
        assert [c for _, c, _ in sorted(got[p])] == [t for _, t in want], p
        assert all(abs(s + v) < 2e-6 for (_, _, s), (v, _) in zip(sorted(got[p]), want))
    assert None not in got
    lists = {r.prefix: r.retrieved_queries for r in TB.hybrid_lists(top, test).collect()}
    assert lists["ab"] == [c for _, c, _ in sorted(got["ab"])] and len(lists) == len(prefixes)
    assert TB.hybrid_lists(top, test).count() == len(prefixes) + 2


def test_hybrid_of_empty_tables(spark):
    _, pool, features, _, test = tables(spark)
    assert TB.hybrid_topk(test.limit(0), pool, features, 5).count() == 0
    assert TB.hybrid_topk(test, pool.limit(0), features, 5).count() == 0


def test_retrieval_with_another_encoder(spark):
    pool, pool_df, _, _, _ = tables(spark)
    encode = D.model_encoder(load_letters)
    r = TC.build_retrieval(pool_df, encode)
    got = {x.candidate: list(x.cvec) for x in r.pool_emb.collect()}
    assert set(got) == set(pool)
    assert all(got[t] == v.tolist() for t, v in zip(pool, load_letters()(pool)))


def test_metrics_by_split(spark):
    rng = np.random.default_rng(4)
    rows = [(bool(i % 3 == 0), int(t), round(float(s), 1), int(w)) for i, (t, s, w) in enumerate(
        zip(rng.integers(0, 2, 90), rng.random(90), rng.integers(1, 4, 90)))]
    df = spark.createDataFrame(rows, "is_valid boolean, target int, score double, weight int")
    got = {r.is_valid: r for r in E.metrics_by(df, "is_valid", weight="weight").collect()}
    for side in (True, False):
        x = [(t, s) for v, t, s, w in rows if v == side for _ in range(w)]
        pos, neg = [s for t, s in x if t], [s for t, s in x if not t]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        tp, fp = sum(s >= 0.5 for s in pos), sum(s >= 0.5 for s in neg)
        r = got[side]
        assert (r.n_rows, r.n_pos) == (len(x), len(pos)) and abs(r.auc - auc) < 1e-9
        assert abs(r.precision - tp / (tp + fp)) < 1e-9 and abs(r.recall - tp / len(pos)) < 1e-9
        assert abs(r.accuracy - (tp + len(neg) - fp) / len(x)) < 1e-9
        assert abs(r.f1 - 2 * r.precision * r.recall / (r.precision + r.recall)) < 1e-9
    one = E.metrics_by(df.where("target = 1"), "is_valid").collect()
    assert all(r.auc is None and r.recall > 0 for r in one) and E.metrics_by(df.limit(0), "is_valid").count() == 0


@pytest.fixture(scope="module")
def prepared(spark):
    """Rows that one feature separates."""
    rows = [(f"p{i % 9}", f"c{i}", i % 2, 1 + i % 3, float(i % 2) + (i * 7919 % 100) / 120.0, float(i % 11)) for i in range(600)]
    ds = spark.createDataFrame(rows, "prefix string, candidate string, target int, weight long, a double, b double")
    return cut(TC.prepare_features(ds, ["a", "b"]))


def test_saved_model_metadata(spark, prepared, tmp_path):
    model = TC.train_reranker(prepared, dict(maxIter=8))
    metrics = {r.is_valid: r for r in TC.split_metrics(model, prepared).collect()}
    assert metrics[True].auc > 0.8 and metrics[False].auc > 0.8
    assert metrics[True].n_rows + metrics[False].n_rows == sum(1 + i % 3 for i in range(600))
    path = f"file://{tmp_path}/m"
    TC.save_model(model, path, ["a", "b"], prepared)
    back, meta = TC.load_model(path)
    assert meta["best_iteration"] == model.stages[-1].getNumTrees <= 8
    assert meta["feature_names"] == ["a", "b"] and len(meta["training_date"]) == 19
    assert abs(meta["metrics"]["valid"]["auc"] - metrics[True].auc) < 1e-9
    csv = spark.read.option("header", True).csv(f"{path}/feature_importance").collect()
    assert [r.feature for r in csv] == ["a", "b"] and json.dumps(meta)
    assert back.transform(prepared).select("probability").first() == model.transform(prepared).select("probability").first()
    imp = {r.feature: r for r in TC.feature_importance(model, ["a", "b"], rows=prepared).collect()}
    assert imp["a"].importance > imp["b"].importance and imp["a"].mean_positive > imp["a"].mean_negative


def test_shared_tables_follow_their_input(spark, tmp_path):
    made = []

    def build():
        made.append(spark.read.parquet(path).count())
        return cut(spark.range(made[-1]))
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    assert [shared(spark, "x", [path], build).count() for _ in range(3)] == [3, 3, 3] and made == [3]
    spark.range(5).write.mode("append").parquet(path)
    assert shared(spark, "x", [path], build).count() == 8 and made == [3, 8]
    assert shared(spark, "y", [path], build).count() == 8 and len(made) == 3


def test_cut_tables_are_parquet_in_the_shared_folder(spark):
    df = cut(spark.range(4).selectExpr("id", "id * 2 AS b"))
    files = df.inputFiles()
    assert files and all(session.ensure_checkpoint_dir(spark).split("://")[-1].split(":")[-1] in f for f in files)
    assert "ReadSchema: struct<b:bigint>" in df.select("b")._jdf.queryExecution().executedPlan().toString()
    assert os.path.basename(files[0]).endswith(".parquet")


def test_texts_are_encoded_by_many_tasks(spark):
    from typeahead.plans import track_c as TC
    texts = spark.range(3 * TC.ENCODE_ROWS).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("query"))

    def encode(df, col, out):
        return df.withColumn(out, F.array(F.spark_partition_id().cast("float")))
    pemb = TC.prefix_embeddings(texts.withColumnRenamed("query", "prefix"), encode)
    cemb = TC.build_retrieval(texts.distinct(), encode).pool_emb
    for emb, vec in ((pemb, "pvec"), (cemb, "cvec")):
        assert emb.count() == 3 * TC.ENCODE_ROWS
        assert emb.select(vec).distinct().count() == 3
