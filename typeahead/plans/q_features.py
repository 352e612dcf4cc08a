"""Registered queries: candidate tables, pair features, labelled rows, re-ranker
(J3, J4, J9-J11, U3, M1-M8, M13, M17-M19, H2)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import features as FT
from ..operators import topk as W
from ..sources import fixtures as fx
from ..session import cut, reuse, shared
from . import track_c as TC
from .q_dense import _sql_dot, _sql_sq_l2, emb_sql
from .q_eval import split_sql
from .q_lexical import _BM25_CTE
from .registry import register

_CU = fx.with_fx("fx_pool", "fx_test", "fx_query_features")[:-1] + _BM25_CTE + f"""
, te AS {emb_sql('(SELECT DISTINCT prefix FROM fx_test)', 'prefix', 'prefix')},
pl AS {emb_sql('fx_pool', 'query', 'query')},
dn AS (SELECT prefix, candidate, semantic_distance FROM (SELECT *, row_number() OVER (PARTITION BY prefix
         ORDER BY semantic_distance, candidate) AS r FROM (SELECT te.prefix, pl.query AS candidate,
         round({_sql_sq_l2('te.embedding', 'pl.embedding')}, 6) AS semantic_distance FROM te, pl)) WHERE r <= {TC.N_DENSE}),
bm AS (SELECT prefix, candidate, bm25_score FROM (SELECT *, row_number() OVER (PARTITION BY prefix
         ORDER BY bm25_score DESC, candidate) AS r FROM scores) WHERE r <= {TC.N_LEXICAL}),
cu0 AS (SELECT coalesce(bm.prefix, dn.prefix) AS prefix, coalesce(bm.candidate, dn.candidate) AS candidate,
               coalesce(bm.bm25_score, 0e0) AS bm25_score, dn.semantic_distance
        FROM bm FULL OUTER JOIN dn ON bm.prefix = dn.prefix AND bm.candidate = dn.candidate),
cu AS (SELECT prefix, candidate, bm25_score, coalesce(semantic_distance,
              max(semantic_distance) OVER (PARTITION BY prefix), 1000e0) AS semantic_distance FROM cu0),
cs AS (SELECT x AS lx, list_filter(list_distinct(string_split(lower(x), '')), lambda c: c <> '') AS cs
       FROM (SELECT DISTINCT prefix AS x FROM cu UNION SELECT DISTINCT candidate FROM cu)),
feat AS (SELECT cu.prefix, cu.candidate, cu.bm25_score, cu.semantic_distance,
   CAST(length(cu.prefix) AS INT) AS prefix_length, CAST(length(cu.candidate) AS INT) AS candidate_length,
   length(cu.prefix) / greatest(length(cu.candidate), 1) AS length_ratio,
   CAST(contains(lower(cu.candidate), lower(cu.prefix)) AS INT) AS prefix_in_candidate,
   CAST(starts_with(lower(cu.candidate), lower(cu.prefix)) AS INT) AS candidate_starts_with_prefix,
   CAST(len(list_intersect(a.cs, b.cs)) AS INT) AS char_overlap,
   len(list_intersect(a.cs, b.cs)) / greatest(len(list_distinct(list_concat(a.cs, b.cs))), 1) AS char_jaccard,
   CASE WHEN na > 0 AND nb > 0 THEN ab / (na * nb) ELSE 0e0 END AS cosine_similarity,
   coalesce(CAST(f.orders AS DOUBLE), 0e0) AS popularity_orders, coalesce(f.volume, 0e0) AS popularity_volume,
   coalesce(CAST(f.catalog_clicks AS DOUBLE), 0e0) AS popularity_catalog_clicks,
   coalesce(CAST(f.catalog_views AS DOUBLE), 0e0) AS popularity_catalog_views
 FROM cu JOIN cs a ON a.lx = cu.prefix JOIN cs b ON b.lx = cu.candidate
 JOIN (SELECT te.prefix, pl.query AS candidate, {_sql_dot('te.embedding', 'pl.embedding')} AS ab,
              sqrt({_sql_dot('te.embedding', 'te.embedding')}) AS na, sqrt({_sql_dot('pl.embedding', 'pl.embedding')}) AS nb
       FROM te, pl) v ON v.prefix = cu.prefix AND v.candidate = cu.candidate
 LEFT JOIN fx_query_features f ON f.query = cu.candidate)
"""


def _test_rows(spark, d):
    ins = fx.inputs(spark, d)
    r = TC.build_retrieval(ins["pool"])
    prefixes = ins["test"].select("prefix").distinct()
    pemb = TC.prefix_embeddings(prefixes)
    cu = reuse(TC.candidates(r, prefixes, pemb))
    return ins, r, pemb, cu


def _r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


@register("candidate_union", _CU + "SELECT prefix, candidate, round(bm25_score, 6) AS bm25_score, "
          "round(semantic_distance, 6) AS semantic_distance FROM cu")
def q_candidate_union(spark, d):
    cu = _test_rows(spark, d)[3]
    return cu.select("prefix", "candidate", *_r6(["bm25_score", "semantic_distance"]))


@register("popularity_lookup", _CU + "SELECT prefix, candidate, popularity_orders, popularity_volume, "
          "popularity_catalog_clicks, popularity_catalog_views FROM feat")
def q_popularity_lookup(spark, d):
    ins, _, _, cu = _test_rows(spark, d)
    return FT.pair_popularity_features(cu, ins["features"]).select(
        "prefix", "candidate", *[f"popularity_{c}" for c in FT.POPULARITY_COLUMNS])


@register("pair_length_features", _CU + "SELECT prefix, candidate, prefix_length, candidate_length, "
          "round(length_ratio, 6) AS length_ratio FROM feat")
def q_pair_length_features(spark, d):
    cu = _test_rows(spark, d)[3]
    return cu.select("prefix", "candidate", *FT.pair_length_features()).select(
        "prefix", "candidate", "prefix_length", "candidate_length", F.round("length_ratio", 6).alias("length_ratio"))


@register("pair_containment", _CU + "SELECT prefix, candidate, prefix_in_candidate, candidate_starts_with_prefix FROM feat")
def q_pair_containment(spark, d):
    return _test_rows(spark, d)[3].select("prefix", "candidate", *FT.pair_containment())


@register("pair_char_overlap", _CU + "SELECT prefix, candidate, char_overlap, round(char_jaccard, 6) AS char_jaccard FROM feat")
def q_pair_char_overlap(spark, d):
    o = FT.pair_char_overlap(_test_rows(spark, d)[3])
    return o.select("prefix", "candidate", "char_overlap", F.round("char_jaccard", 6).alias("char_jaccard"))


@register("pair_popularity_features", _CU + "SELECT prefix, candidate, popularity_orders, popularity_volume, "
          "popularity_catalog_clicks, popularity_catalog_views FROM feat")
def q_pair_popularity_features(spark, d):
    return q_popularity_lookup(spark, d)


@register("pair_features", _CU + "SELECT prefix, candidate, " + ", ".join(
    f"round({c}, 6) AS {c}" if c in ("cosine_similarity", "bm25_score", "length_ratio", "char_jaccard") else c
    for c in FT.FEATURE_COLUMNS) + " FROM feat")
def q_pair_features(spark, d):
    ins, r, pemb, cu = _test_rows(spark, d)
    f = FT.pair_features(cu, pemb, r.pool_emb, ins["features"])
    return f.select("prefix", "candidate", *[
        F.round(c, 6).alias(c) if c in ("cosine_similarity", "bm25_score", "length_ratio", "char_jaccard")
        else F.col(c) for c in FT.FEATURE_COLUMNS])


@register("align_features", _CU + "SELECT prefix, candidate, " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in FT.FEATURE_COLUMNS) + ", 0e0 AS popularity_extra FROM feat")
def q_align_features(spark, d):
    ins, r, pemb, cu = _test_rows(spark, d)
    f = FT.pair_features(cu, pemb, r.pool_emb, ins["features"])
    a = FT.align_features(f, FT.FEATURE_COLUMNS + ["popularity_extra"], keep=["prefix", "candidate"])
    return a.select("prefix", "candidate", *_r6(FT.FEATURE_COLUMNS), "popularity_extra")


def _lists(spark, d):
    """BM25 and dense top-10 per test prefix, ranked."""
    _, _, _, cu = _test_rows(spark, d)
    a = W.topk_per_key(cu.where("bm25_score > 0"), "prefix", "bm25_score", 10)
    b = W.topk_per_key(cu, "prefix", "semantic_distance", 10, ascending=True)
    return a.select("prefix", "candidate", "rank"), b.select("prefix", "candidate", "rank")


_LISTS_SQL = _CU + """, la AS MATERIALIZED (SELECT * FROM (SELECT prefix, candidate, CAST(row_number() OVER (PARTITION BY prefix
   ORDER BY bm25_score DESC, candidate) AS INT) AS rank FROM cu WHERE bm25_score > 0) WHERE rank <= 10),
lb AS MATERIALIZED (SELECT * FROM (SELECT prefix, candidate, CAST(row_number() OVER (PARTITION BY prefix
   ORDER BY semantic_distance, candidate) AS INT) AS rank FROM cu) WHERE rank <= 10)
"""


@register("compare_methods", _LISTS_SQL + """, u AS MATERIALIZED (
  SELECT prefix, candidate, la.rank AS ra, lb.rank AS rb FROM la FULL OUTER JOIN lb USING (prefix, candidate))
SELECT prefix, rank, max(a) AS candidate_a, max(b) AS candidate_b, max(a_in_b) AS a_in_b, max(b_in_a) AS b_in_a FROM (
  SELECT prefix, ra AS rank, candidate AS a, NULL AS b, CAST(rb IS NOT NULL AS INT) AS a_in_b, 0 AS b_in_a FROM u WHERE ra IS NOT NULL
  UNION ALL SELECT prefix, rb, NULL, candidate, 0, CAST(ra IS NOT NULL AS INT) FROM u WHERE rb IS NOT NULL) GROUP BY prefix, rank""")
def q_compare_methods(spark, d):
    a, b = _lists(spark, d)
    return C.compare_methods(a, b)


@register("compare_methods_summary", _LISTS_SQL + """SELECT prefix,
  CAST(sum(CASE WHEN ia AND ib THEN 1 ELSE 0 END) AS BIGINT) AS n_both,
  CAST(sum(CASE WHEN ia AND NOT ib THEN 1 ELSE 0 END) AS BIGINT) AS n_only_a,
  CAST(sum(CASE WHEN ib AND NOT ia THEN 1 ELSE 0 END) AS BIGINT) AS n_only_b FROM (
  SELECT coalesce(x.prefix, y.prefix) AS prefix, x.prefix IS NOT NULL AS ia, y.prefix IS NOT NULL AS ib
  FROM la x FULL OUTER JOIN lb y ON x.prefix = y.prefix AND x.candidate = y.candidate) GROUP BY prefix""")
def q_compare_methods_summary(spark, d):
    a, b = _lists(spark, d)
    return C.compare_methods_summary(a, b)


@register("method_set_ops", _LISTS_SQL + """SELECT prefix,
  array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), '|') AS both_items,
  array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), '|') AS only_a,
  array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), '|') AS only_b
FROM (SELECT coalesce(p.prefix, q.prefix) AS prefix, p.a, q.b FROM
  (SELECT prefix, list(candidate) AS a FROM la GROUP BY prefix) p FULL OUTER JOIN
  (SELECT prefix, list(candidate) AS b FROM lb GROUP BY prefix) q ON p.prefix = q.prefix)""")
def q_method_set_ops(spark, d):
    a, b = _lists(spark, d)
    la = W.collect_ranked_list(a, "prefix", out="list_a")
    lb = W.collect_ranked_list(b, "prefix", out="list_b")
    s = W.method_set_ops(la, lb)
    return s.select("prefix", *[F.array_join(F.array_sort(c), "|").alias(n)
                                for c, n in (("both", "both_items"), ("only_a", "only_a"), ("only_b", "only_b"))])


# ------------------------------------------------------------- labelled rows

def _reranking_dataset(spark, d):
    ins = fx.inputs(spark, d)
    return TC.reranking_dataset(ins["train"], ins["pool"], ins["features"])


def _ensure_true_query(spark, d):
    ins = fx.inputs(spark, d)
    pairs = ins["train"].dropna(subset=["prefix", "query"]).select("prefix", "query").distinct()
    r = TC.build_retrieval(ins["pool"])
    j = C.ensure_true_query(TC.candidates(r, pairs.select("prefix"), TC.prefix_embeddings(pairs)), pairs)
    return j.select("prefix", "candidate", *_r6(["bm25_score", "semantic_distance"]))


def _prepare_features(spark, d):
    p = TC.prepare_features(_reranking_dataset(spark, d)).drop("features")
    return p.select("prefix", "candidate", "target", "weight", "is_valid", *_r6(FT.FEATURE_COLUMNS))


def _prep_sql() -> str:
    k = "prefix || '|' || candidate"
    return _m6_sql() + f"SELECT prefix, candidate, target, weight, {split_sql(k)} AS is_valid, " + ", ".join(
        f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in FT.FEATURE_COLUMNS) + " FROM feat"


def _late_register():
    register("ensure_true_query", _m6_sql() + "SELECT prefix, candidate, round(bm25_score, 6) AS bm25_score, "
             "round(semantic_distance, 6) AS semantic_distance FROM sc")(_ensure_true_query)
    register("prepare_features", _prep_sql())(_prepare_features)
    register("reranking_dataset", _m6_select_sql())(lambda spark, d: _m6_select(_reranking_dataset(spark, d)))
    register("sample_negatives", _m6_sql() + "SELECT prefix, query, occ, candidate FROM neg")(
        lambda spark, d: _sample_negatives(spark, d))


def _sample_negatives(spark, d):
    ins = fx.inputs(spark, d)
    pairs = cut(ins["train"].dropna(subset=["prefix", "query"]).groupBy("prefix", "query").agg(F.count(F.lit(1)).alias("n")))
    r = TC.build_retrieval(ins["pool"])
    cands = TC.candidates(r, pairs.select("prefix").distinct(), TC.prefix_embeddings(pairs))
    return FT.sample_negatives(pairs, cands, repeats="n")


def _model(spark, d):
    """The inputs, the written training rows and the model fitted on them, once per session
    and input."""
    ins = fx.inputs(spark, d)

    def fit():
        prep = cut(TC.prepare_features(TC.reranking_dataset(ins["train"], ins["pool"], ins["features"])))
        return prep, TC.train_reranker(prep)
    return ins, *shared(spark, "reranker", [f"{d}/{t}.parquet" for t in ("part", "lineitem")], fit)


@register("train_reranker")
def q_train_reranker(spark, d):
    _, prep, model = _model(spark, d)
    out = model.transform(prep)
    return out.select("prefix", "candidate", "target", "is_valid",
                      F.round(vector_to_array(F.col("probability"))[1], 6).alias("score"))


@register("feature_importance")
def q_feature_importance(spark, d):
    _, prep, model = _model(spark, d)
    return TC.feature_importance(model, FT.FEATURE_COLUMNS, rows=prep)


@register("model_split_metrics")
def q_model_split_metrics(spark, d):
    """M9, M10 of the fitted model on its own training and validation rows."""
    _, prep, model = _model(spark, d)
    m = TC.split_metrics(model, prep)
    return m.select("is_valid", "n_rows", "n_pos", *_r6(["auc", "accuracy", "precision", "recall", "f1"]))


@register("rerank_topk")
def q_rerank_topk(spark, d):
    ins, _, model = _model(spark, d)
    return TC.rerank_topk(model, ins["test"], ins["pool"], ins["features"])


@register("explain_prefix")
def q_explain_prefix(spark, d):
    ins, _, model = _model(spark, d)
    prefixes = ins["test"].select("prefix").where(F.col("prefix").isNotNull()).distinct()
    return TC.explain_prefix(model, prefixes, ins["pool"], ins["features"])


# ------------------------------------------------------ labelled rows oracle

def _m6_sql() -> str:
    head = fx.with_fx("fx_pool", "fx_test", "fx_query_features")[:-1]
    body = _CU[len(head):].replace("(SELECT DISTINCT prefix FROM fx_test)", "(SELECT DISTINCT prefix FROM pairs)")
    new_head = (fx.with_fx("fx_pool", "fx_train", "fx_query_features")[:-1]
                + ",\npairs AS (SELECT prefix, query, row_number() OVER (PARTITION BY prefix, query) - 1 AS occ FROM fx_train "
                  "WHERE prefix IS NOT NULL AND query IS NOT NULL)")
    pre, post = body.split("\ncs AS (", 1)
    pre += "\n"
    md5i = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
    key = "'42|' || p.prefix || '|' || p.query || '|' || p.occ"
    labelled = f"""ranked AS (SELECT prefix, candidate, row_number() OVER (PARTITION BY prefix
   ORDER BY md5('42|' || prefix || '|' || candidate), candidate) - 1 AS pos FROM cu),
sizes AS (SELECT prefix, count(*) AS n FROM ranked GROUP BY prefix),
pp AS (SELECT p.prefix, p.query, p.occ, s.n, 5 + {md5i.format(key)} % 6 AS want,
              {md5i.format(key + " || '|start'")} % s.n AS start FROM pairs p JOIN sizes s ON s.prefix = p.prefix),
slots AS (SELECT prefix, query, occ, want, j, (start + j) % n AS pos FROM pp, unnest(range(0, least(10, n - 1) + 1)) AS u(j)),
neg0 AS (SELECT s.prefix, s.query, s.occ, r.candidate, s.j, s.want FROM slots s JOIN ranked r
         ON r.prefix = s.prefix AND r.pos = s.pos WHERE r.candidate <> s.query),
neg AS (SELECT prefix, query, occ, candidate FROM (SELECT *, row_number() OVER (PARTITION BY prefix, query, occ ORDER BY j) AS rr
        FROM neg0) WHERE rr <= want),
rws AS (SELECT prefix, query AS candidate, 1 AS target, count(DISTINCT occ) AS weight FROM neg GROUP BY 1, 2
        UNION ALL SELECT prefix, candidate, 0, count(*) FROM neg GROUP BY 1, 2),
sc AS (SELECT prefix, candidate, bm25_score, semantic_distance FROM cu
       UNION ALL SELECT DISTINCT p.prefix, p.query, 0e0, 0e0 FROM pairs p
       WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.prefix = p.prefix AND cu.candidate = p.query)),
fin AS (SELECT r.prefix, r.candidate, r.target, r.weight, coalesce(sc.bm25_score, 0e0) AS bm25_score, sc.semantic_distance
        FROM rws r LEFT JOIN sc ON sc.prefix = r.prefix AND sc.candidate = r.candidate),
"""
    post = post.replace("FROM cu UNION SELECT DISTINCT candidate FROM cu", "FROM fin UNION SELECT DISTINCT candidate FROM fin")
    post = post.replace("feat AS (SELECT cu.prefix, cu.candidate,", "feat AS (SELECT cu.prefix, cu.candidate, cu.target, cu.weight,")
    post = post.replace(" FROM cu JOIN cs a", " FROM fin cu JOIN cs a")
    post = post.replace("JOIN (SELECT te.prefix, pl.query AS candidate", "LEFT JOIN (SELECT te.prefix, pl.query AS candidate")
    return new_head + pre + labelled + "cs AS (" + post


_M6_OUT = ["prefix", "candidate", "target", "weight", "semantic_distance"] + FT.FEATURE_COLUMNS
_M6_ROUND = ("cosine_similarity", "bm25_score", "length_ratio", "char_jaccard", "semantic_distance")


def _m6_select_sql() -> str:
    return _m6_sql() + "SELECT " + ", ".join(
        f"round({c}, 6) AS {c}" if c in _M6_ROUND else c for c in _M6_OUT) + " FROM feat"


def _m6_select(ds):
    return ds.select(*[F.round(c, 6).alias(c) if c in _M6_ROUND else F.col(c) for c in _M6_OUT])


_late_register()
