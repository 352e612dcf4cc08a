"""Registered queries: dense vectors, k-NN and hybrid scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense as D
from ..operators import lexical as L
from ..operators import popularity as P
from ..sources import fixtures as fx
from ..sources.tables import read_table
from ..operators.topk import collect_ranked_list
from . import sqlfrag as S
from .q_lexical import _HASHED_CTE
from .registry import register

N_DENSE = 250
HYBRID_K = 150
# The hybrid run's weights.
HYBRID_ALPHA = 0.6
HYBRID_POP_WEIGHT = 0.15


def emb_sql(src: str, key: str, text: str) -> str:
    """D1 in DuckDB: ``(key, embedding FLOAT[])``."""
    g = S.grams_table(src, key, text, 3, "g")
    return f"""(SELECT {key}, list_transform(c, lambda x: (CASE WHEN nrm > 0 THEN x / nrm ELSE 0e0 END)::FLOAT) AS embedding
 FROM (SELECT {key}, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS nrm
  FROM (SELECT {key}, list_transform(range(0, 64), lambda b: len(list_filter(bk, lambda x: x = b))::DOUBLE) AS c
   FROM (SELECT {key}, list_transform(g, lambda s: CAST({S.md5_int('s')} % 64 AS INT)) AS bk FROM {g}))))"""


def _sql_sq_l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) ** 2))"


def _sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


@register("embed_text", fx.with_fx("fx_pool") + f"""SELECT query, CAST(i - 1 AS INT) AS dim,
 round(embedding[i]::DOUBLE, 6) AS value FROM {emb_sql('fx_pool', 'query', 'query')}, unnest(range(1, 65)) AS u(i)""")
def q_embed_text(spark, d):
    from ..session import reuse
    e = reuse(D.embed_text(fx.fx_pool(spark, d), "query"))
    return e.select("query", F.posexplode("embedding").alias("dim", "v")) \
        .select("query", "dim", F.round(F.col("v").cast("double"), 6).alias("value"))


def _emb_table(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("vec"))


_KNN_SQL = f"""WITH pairs AS (SELECT a.vec_id AS probe_id, b.vec_id AS item_id,
  round({_sql_sq_l2('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a, embeddings b),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY score, item_id) AS INT) AS rank FROM pairs)
SELECT * FROM r WHERE rank <= {N_DENSE}"""


def _knn(spark, d):
    e = _emb_table(spark, d)
    return D.knn_l2(e.withColumnRenamed("vec_id", "probe_id"), e.withColumnRenamed("vec_id", "item_id"), N_DENSE,
                    probe_key="probe_id", item_key="item_id")


@register("knn_l2", _KNN_SQL)
def q_knn_l2(spark, d):
    return _knn(spark, d)


@register("knn_l2_batch", _KNN_SQL.replace(
    f"SELECT * FROM r WHERE rank <= {N_DENSE}",
    f"SELECT probe_id, CAST(count(*) AS INT) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS items "
    f"FROM r WHERE rank <= {N_DENSE} GROUP BY probe_id"))
def q_knn_l2_batch(spark, d):
    lists = collect_ranked_list(_knn(spark, d), "probe_id", item="item_id", out="items")
    return lists.select("probe_id", F.size("items").alias("n_items"),
                        F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@register("knn_lsh_join")
def q_knn_lsh_join(spark, d):
    e = _emb_table(spark, d)
    return D.knn_lsh_join(e.withColumnRenamed("vec_id", "probe_id"), e.withColumnRenamed("vec_id", "item_id"),
                          N_DENSE, probe_key="probe_id", item_key="item_id")


_PAIRS_SQL = fx.with_fx("fx_train") + f""", pairs AS (SELECT DISTINCT prefix, query FROM fx_train
  WHERE prefix IS NOT NULL AND query IS NOT NULL),
pe AS {emb_sql('(SELECT DISTINCT prefix FROM pairs)', 'prefix', 'prefix')},
qe AS {emb_sql('(SELECT DISTINCT query FROM pairs)', 'query', 'query')},
j AS (SELECT pairs.prefix, pairs.query, pe.embedding AS a, qe.embedding AS b
      FROM pairs JOIN pe USING (prefix) JOIN qe USING (query))
"""


def _pairs(spark, d):
    t = fx.fx_train(spark, d).dropna(subset=["prefix", "query"]).select("prefix", "query").distinct()
    pe = D.embed_text(t.select("prefix").distinct(), "prefix", "a")
    qe = D.embed_text(t.select("query").distinct(), "query", "b")
    return t.join(pe, "prefix").join(qe, "query")


@register("pair_l2_distance", _PAIRS_SQL + f"SELECT prefix, query, round(sqrt({_sql_sq_l2('a', 'b')}), 6) AS l2 FROM j")
def q_pair_l2_distance(spark, d):
    return _pairs(spark, d).select("prefix", "query", F.round(D.pair_l2_distance("a", "b"), 6).alias("l2"))


@register("cosine_similarity", _PAIRS_SQL + f"""SELECT prefix, query, round(CASE WHEN na > 0 AND nb > 0
  THEN ab / (na * nb) ELSE 0e0 END, 6) AS cosine FROM (SELECT prefix, query, {_sql_dot('a', 'b')} AS ab,
  sqrt({_sql_dot('a', 'a')}) AS na, sqrt({_sql_dot('b', 'b')}) AS nb FROM j)""")
def q_cosine_similarity(spark, d):
    return _pairs(spark, d).select("prefix", "query", F.round(D.cosine_similarity("a", "b"), 6).alias("cosine"))


_PQ_SQL = f""", te AS {emb_sql('(SELECT DISTINCT prefix FROM fx_test)', 'prefix', 'prefix')},
pl AS {emb_sql('fx_pool', 'query', 'query')}
"""


def _prefix_pool_emb(spark, d):
    te = D.embed_text(fx.fx_test(spark, d).select("prefix").distinct(), "prefix", "vec")
    pl = D.embed_text(fx.fx_pool(spark, d), "query", "vec")
    return te, pl


@register("dense_dot_scores", fx.with_fx("fx_test", "fx_pool") + _PQ_SQL + f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY prefix ORDER BY score DESC, query) AS INT) AS rank
FROM (SELECT te.prefix, pl.query, round({_sql_dot('te.embedding', 'pl.embedding')}, 6) AS score FROM te, pl))
WHERE rank <= {N_DENSE}""")
def q_dense_dot_scores(spark, d):
    te, pl = _prefix_pool_emb(spark, d)
    return D.dense_dot_scores(te, pl, N_DENSE, probe_key="prefix", item_key="query")


# ------------------------------------------------------------------ hybrid

def _hdense_sql(alpha: float) -> str:
    return (f"list_transform(te.embedding, lambda x: x::DOUBLE / (sqrt({_sql_dot('te.embedding', 'te.embedding')}) "
            f"+ 1e-10) * {alpha}e0)")


@register("hybrid_weights", fx.with_fx("fx_test", "fx_pool")[:-1] + _HASHED_CTE + _PQ_SQL + f"""
SELECT prefix, 'dense' AS kind, CAST(i - 1 AS INT) AS idx, round(hd[i], 6) AS weight
FROM (SELECT te.prefix, {_hdense_sql(HYBRID_ALPHA)} AS hd FROM te), unnest(range(1, 65)) AS u(i)
UNION ALL SELECT prefix, 'sparse', bucket, round(q_weight_l2 * {1 - HYBRID_ALPHA}e0, 6) FROM pw""")
def q_hybrid_weights(spark, d):
    te, _ = _prefix_pool_emb(spark, d)
    dense = te.select("prefix", F.posexplode(D.scale_l2("vec", HYBRID_ALPHA)).alias("idx", "weight")) \
        .select("prefix", F.lit("dense").alias("kind"), "idx", F.round("weight", 6).alias("weight"))
    m = L.bm25_hashed_fit(fx.fx_pool(spark, d), "query")
    qw = L.bm25_hashed_query_weights(m, fx.fx_test(spark, d))
    sparse = qw.select("prefix", F.lit("sparse").alias("kind"), F.col("bucket").alias("idx"),
                       F.round(F.col("q_weight_l2") * (1 - HYBRID_ALPHA), 6).alias("weight"))
    return dense.unionByName(sparse)


_POP_SQL = ", ".join(f"CASE WHEN m_{c} > 0 THEN {c} / m_{c} ELSE 0e0 END AS {c}_n" for c in P.FEATURES)


_HYBRID_SQL = (fx.with_fx("fx_test", "fx_pool", "fx_query_features")[:-1] + _HASHED_CTE + _PQ_SQL + f"""
, e AS (SELECT p.query, coalesce(f.orders, 0) AS orders, coalesce(f.volume, 0) AS volume,
           coalesce(f.catalog_clicks, 0) AS catalog_clicks, coalesce(f.catalog_views, 0) AS catalog_views
        FROM fx_pool p LEFT JOIN fx_query_features f ON p.query = f.query),
pp AS (SELECT query, 0.4e0 * orders_n + 0.3e0 * catalog_clicks_n + 0.2e0 * volume_n + 0.1e0 * catalog_views_n AS pop
       FROM (SELECT query, {_POP_SQL} FROM e, (SELECT {", ".join(f"max({c}) AS m_{c}" for c in P.FEATURES)} FROM e))),
sp AS (SELECT prefix, query, sum(q_weight_l2 * {1 - HYBRID_ALPHA}e0 * w) AS sparse FROM pw JOIN dw USING (bucket)
       GROUP BY prefix, query),
hd AS (SELECT te.prefix, {_hdense_sql(HYBRID_ALPHA)} AS h FROM te),
allp AS (SELECT hd.prefix, pl.query, {_sql_dot('hd.h', 'pl.embedding')} AS dense FROM hd, pl),
sc AS (SELECT allp.prefix, allp.query AS candidate,
              round(dense + coalesce(sp.sparse, 0e0) + {HYBRID_POP_WEIGHT}e0 * pp.pop, 6) AS hybrid_score
       FROM allp JOIN pp USING (query) LEFT JOIN sp ON sp.prefix = allp.prefix AND sp.query = allp.query)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY prefix ORDER BY hybrid_score DESC, candidate) AS INT)
  AS rank FROM sc) WHERE rank <= {HYBRID_K}""")


@register("hybrid_topk", _HYBRID_SQL)
def q_hybrid_topk(spark, d):
    from .track_b import hybrid_topk
    ins = fx.inputs(spark, d)
    return hybrid_topk(ins["test"], ins["pool"], ins["features"], HYBRID_K, HYBRID_ALPHA, HYBRID_POP_WEIGHT)


@register("hybrid_submission", fx.with_fx("fx_test").rstrip() + f""", top AS ({_HYBRID_SQL}),
lists AS (SELECT prefix, list(candidate ORDER BY rank) AS l FROM top GROUP BY prefix)
SELECT coalesce(t.prefix, '') AS prefix, CAST(len(coalesce(l, [])) AS INT) AS n_items,
       coalesce(array_to_string(l, '|'), '') AS items FROM fx_test t LEFT JOIN lists USING (prefix)""")
def q_hybrid_submission(spark, d):
    """D9's lists for every test row."""
    from .track_b import hybrid_lists
    lists = hybrid_lists(q_hybrid_topk(spark, d), fx.fx_test(spark, d))
    return lists.select("prefix", F.size("retrieved_queries").alias("n_items"),
                        F.array_join("retrieved_queries", "|").alias("items"))
