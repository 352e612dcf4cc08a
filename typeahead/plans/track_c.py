"""Candidate generation + learned re-ranker.

Candidates for a set of prefixes are BM25 top-250 FULL OUTER dense top-250
(squared L2 over the embedding column), computed once per distinct prefix.
Training rows join those candidates to every labelled pair, force the true
query in, sample negatives and compute the feature row.  The model is Spark
ML gradient-boosted trees on an assembled feature vector.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense as D
from ..operators import features as FT
from ..operators import lexical as L
from ..operators.candidates import candidate_union, ensure_true_query, guard_empty_prefix
from ..operators.evaluate import metrics_by
from ..operators.topk import collect_ranked_list, topk_per_key
from ..session import cut, reuse

ENCODE_ROWS = 2048  # texts, about, that a task encodes
N_LEXICAL = 250
N_DENSE = 250
TOP_K = 150
# Boosted-tree settings of the re-ranker.
GBT_PARAMS = dict(maxIter=500, stepSize=0.05, maxDepth=5, minInstancesPerNode=20,
                  subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)


@dataclass
class Retrieval:
    index: L.BM25Index
    pool_emb: DataFrame        # candidate, cvec
    encode: Callable           # (df, column, out) -> df with a vector column


def _dealt(texts: DataFrame) -> DataFrame:
    """Written texts, dealt to tasks by their number: a shuffle of short texts is merged by its
    bytes into one task or a few, while the work of encoding goes by the text."""
    texts = cut(texts)
    n = -(-texts.count() // ENCODE_ROWS)
    return texts.repartition(n) if n > 1 else texts


def build_retrieval(pool: DataFrame, encode=D.embed_text) -> Retrieval:
    pool = _dealt(pool.select("query"))
    idx = L.bm25_index(pool, "query", 3)
    emb = cut(encode(pool, "query", "cvec").select(F.col("query").alias("candidate"), "cvec"))
    return Retrieval(idx, emb, encode)


def prefix_embeddings(prefixes: DataFrame, encode=D.embed_text) -> DataFrame:
    return cut(encode(_dealt(prefixes.select("prefix").distinct()), "prefix", "pvec"))


def candidates(r: Retrieval, prefixes: DataFrame, pemb: DataFrame) -> DataFrame:
    """J3 over BM25 and dense candidates: ``(prefix, candidate, bm25_score, semantic_distance)``."""
    bm = L.bm25_topk(r.index, prefixes, N_LEXICAL)
    dn = D.knn_l2(pemb.select("prefix", F.col("pvec").alias("vec")),
                  r.pool_emb.select("candidate", F.col("cvec").alias("vec")), N_DENSE,
                  probe_key="prefix", item_key="candidate")
    dn = dn.select("prefix", "candidate", F.col("score").alias("semantic_distance"))
    return candidate_union(bm, dn)


def reranking_dataset(train: DataFrame, pool: DataFrame, features: DataFrame, seed: int = 42,
                      encode=D.embed_text) -> DataFrame:
    """M6: labelled feature rows: 1 for the true query, 5-10 sampled negatives.

    Every training row draws its own negatives.  Equal labelled rows come out once, with
    their number as ``weight``."""
    rows = train.dropna(subset=["prefix", "query"])
    pairs = cut(rows.groupBy("prefix", "query").agg(F.count(F.lit(1)).alias("weight")))
    r = build_retrieval(pool, encode)
    pemb = prefix_embeddings(pairs, encode)
    cands = cut(candidates(r, pairs.select("prefix").distinct(), pemb))
    neg, drew = FT.count_negatives(pairs, cands, "weight", seed)
    neg = neg.select("prefix", "candidate", F.lit(0).alias("target"), "weight")
    # a pair without any negative is skipped entirely, its positive too
    kept = pairs.join(drew, ["prefix", "query"], "left_semi")
    pos = kept.select("prefix", F.col("query").alias("candidate"), F.lit(1).alias("target"), "weight")
    # true queries missed by retrieval enter with scores (0, 0)
    scored = ensure_true_query(cands, pairs.select("prefix", "query"))
    rows = pos.unionByName(neg).join(scored, ["prefix", "candidate"], "left").na.fill(0.0, ["bm25_score"])
    return FT.pair_features(rows, pemb, r.pool_emb, features)


def prepare_features(ds: DataFrame, names: list[str] | None = None, seed: int = 42) -> DataFrame:
    """M7: feature columns filled with 0, split flag, assembled vector."""
    names = names or FT.FEATURE_COLUMNS
    a = FT.align_features(ds, names, keep=["prefix", "candidate", "target", "weight"])
    a = FT.stratified_split(a.withColumn("_k", F.concat_ws("|", "prefix", "candidate")), "_k", seed).drop("_k")
    return VectorAssembler(inputCols=names, outputCol="features").transform(a)


def train_reranker(prepared: DataFrame, params: dict | None = None) -> PipelineModel:
    """M8: gradient-boosted trees with a validation-based stop."""
    p = dict(GBT_PARAMS, **(params or {}))
    gbt = GBTClassifier(labelCol="target", featuresCol="features", validationIndicatorCol="is_valid",
                        weightCol="weight", **p)
    return Pipeline(stages=[gbt]).fit(prepared.withColumn("target", F.col("target").cast("double")))


def scored_rows(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """The prepared rows with the model's probability of label 1 as ``score``."""
    out = model.transform(prepared)
    return out.withColumn("score", F.round(vector_to_array("probability")[1], 6))


def split_metrics(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """M9 and M10 on the model's own training and validation rows, one row per ``is_valid``."""
    return metrics_by(scored_rows(model, prepared).select("is_valid", "target", "weight", "score"), "is_valid",
                      weight="weight")


def feature_importance(model: PipelineModel, names: list[str], top: int = 20,
                       rows: DataFrame | None = None) -> DataFrame:
    """Importance per feature, ranked (the model's own small vector), and where the
    prepared ``rows`` are given, the feature's mean over them and over either label."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    columns = [(n, float(v)) for n, v in zip(names, imp)]
    schema = "feature string, importance double"
    if rows is not None:
        by = [("mean", F.lit(True)), ("mean_positive", F.col("target") == 1), ("mean_negative", F.col("target") != 1)]
        got = rows.agg(*[F.round(F.sum(F.when(c, F.col(n) * F.col("weight"))) / F.sum(F.when(c, F.col("weight"))), 6)
                         .alias(f"{n} {k}") for n in names for k, c in by]).first()  # one row
        columns = [(n, v, *(got[f"{n} {k}"] for k, _ in by)) for n, v in columns]
        schema += "".join(f", {k} double" for k, _ in by)
    df = spark.createDataFrame(columns, schema)
    return df.orderBy(F.col("importance").desc(), "feature").limit(top)


def score(model: PipelineModel, rows: DataFrame, names: list[str]) -> DataFrame:
    a = FT.align_features(rows, names, keep=["prefix", "candidate"])
    a = VectorAssembler(inputCols=names, outputCol="features").transform(a)
    out = model.transform(a)
    return out.select("prefix", "candidate", F.round(vector_to_array("probability")[1], 6).alias("relevance_score"),
                      *names)


def rerank_topk(model: PipelineModel, test: DataFrame, pool: DataFrame, features: DataFrame,
                names: list[str] | None = None, k: int = TOP_K, encode=D.embed_text) -> DataFrame:
    """``(prefix, retrieved_queries)`` for every test row."""
    names = names or FT.FEATURE_COLUMNS
    prefixes = test.select("prefix").where(F.col("prefix").isNotNull() & (F.col("prefix") != "")).distinct()
    r = build_retrieval(pool, encode)
    pemb = prefix_embeddings(prefixes, encode)
    rows = FT.pair_features(candidates(r, prefixes, pemb), pemb, r.pool_emb, features)
    s = score(model, rows, names)
    top = topk_per_key(s, "prefix", "relevance_score", k)
    lists = collect_ranked_list(top, "prefix")
    return guard_empty_prefix(test, lists, key_col="prefix", key_fn=lambda c: c)


def explain_prefix(model: PipelineModel, prefixes: DataFrame, pool: DataFrame, features: DataFrame,
                   names: list[str] | None = None, k: int = 10, encode=D.embed_text) -> DataFrame:
    """The top ``k`` re-ranked candidates of the given prefixes with
    their component scores and features."""
    names = names or FT.FEATURE_COLUMNS
    r = build_retrieval(pool, encode)
    pemb = prefix_embeddings(prefixes, encode)
    rows = FT.pair_features(candidates(r, prefixes.select("prefix"), pemb), pemb, r.pool_emb, features)
    return topk_per_key(score(model, rows, names), "prefix", "relevance_score", k)


def save_model(model: PipelineModel, path: str, names: list[str], prepared: DataFrame) -> None:
    """Model directory, importance as CSV, and a metadata JSON: type, features, number of
    trees kept, training date and the metrics of both splits."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(os.path.join(path, "model"))
    feature_importance(model, names, len(names), prepared).coalesce(1).write.mode("overwrite") \
        .option("header", True).csv(os.path.join(path, "feature_importance"))
    metrics = {"valid" if r["is_valid"] else "train": {k: r[k] for k in r.asDict() if k != "is_valid"}
               for r in split_metrics(model, prepared).collect()}  # two rows
    meta = {"model_type": "GBTClassifier", "n_features": len(names), "feature_names": names,
            "best_iteration": int(model.stages[-1].getNumTrees),
            "training_date": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), "metrics": metrics}
    spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(
        os.path.join(path, "metadata"))


def load_model(path: str) -> tuple[PipelineModel, dict]:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(os.path.join(path, "metadata")).first()[0])
    return PipelineModel.load(os.path.join(path, "model")), meta
