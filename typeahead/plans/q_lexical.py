"""Registered queries: BM25 over char n-grams and hashed word BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical as L
from ..sources import fixtures as fx
from . import sqlfrag as S
from .registry import register

# Track C asks for 250 lexical candidates per prefix.
N_BM25 = 250

_BM25_CTE = f""",
docs AS {S.grams_table('fx_pool', 'query', 'query')},
stats AS (SELECT count(*) AS n, sum(len(grams)) / count(*) AS avgdl FROM docs),
post AS (SELECT query, g AS gram, CAST(count(*) AS BIGINT) AS tf, any_value(len(grams)) AS dl
         FROM docs, unnest(grams) AS u(g) GROUP BY query, g),
dfs AS (SELECT gram, CAST(count(*) AS BIGINT) AS df FROM post GROUP BY gram),
idf0 AS (SELECT gram, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, stats),
idf AS (SELECT gram, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM idf0) ELSE r END AS idf FROM idf0),
pg AS (SELECT prefix, g AS gram, count(*) AS qtf
       FROM {S.grams_table('(SELECT DISTINCT prefix FROM fx_test)', 'prefix', 'prefix')},
            unnest(grams) AS u(g) GROUP BY prefix, g),
scores AS (SELECT prefix, query AS candidate,
                  round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS bm25_score
           FROM pg JOIN idf USING (gram) JOIN post USING (gram), stats GROUP BY prefix, query)
"""


def _bm25(spark, d):
    return L.bm25_index(fx.fx_pool(spark, d), "query", 3)


@register("bm25_index", fx.with_fx("fx_pool")[:-1] + _BM25_CTE
          + "SELECT gram, query, tf, CAST(dl AS INT) AS dl FROM post")
def q_bm25_index(spark, d):
    return _bm25(spark, d).postings.select("gram", "query", "tf", "dl")


@register("bm25_corpus_stats", fx.with_fx("fx_pool", "fx_test")[:-1] + _BM25_CTE
          + "SELECT gram, df, round(idf, 6) AS idf, CAST(n AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl "
            "FROM idf, stats")
def q_bm25_corpus_stats(spark, d):
    s = L.bm25_corpus_stats(_bm25(spark, d))
    return s.select("gram", "df", F.round("idf", 6).alias("idf"), "n_docs", F.round("avgdl", 6).alias("avgdl"))


@register("bm25_topk", fx.with_fx("fx_pool", "fx_test")[:-1] + _BM25_CTE + f"""
SELECT * FROM (SELECT prefix, candidate, bm25_score,
  CAST(row_number() OVER (PARTITION BY prefix ORDER BY bm25_score DESC, candidate) AS INT) AS rank
  FROM scores) WHERE rank <= {N_BM25}""")
def q_bm25_topk(spark, d):
    return L.bm25_topk(_bm25(spark, d), fx.fx_test(spark, d), N_BM25)


# ---------------------------------------------------------------- hashed BM25

_HASHED_CTE = f""",
docs AS (SELECT query FROM fx_pool),
qb AS (SELECT DISTINCT query, CAST({S.md5_int('tok')} % 65536 AS INT) AS bucket
       FROM (SELECT query, unnest({S.word_tokens('query')}) AS tok FROM docs)),
dl AS (SELECT query, count(*) AS dl FROM qb GROUP BY query),
hstats AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM docs) AS avgdl),
bdf AS (SELECT bucket, CAST(count(*) AS BIGINT) AS df FROM qb GROUP BY bucket),
dw AS (SELECT query, bucket, 1.0 / (1.6 * (0.25 + 0.75 * dl / avgdl) + 1.0) AS w
       FROM qb JOIN dl USING (query), hstats),
pb AS (SELECT DISTINCT prefix, CAST({S.md5_int('tok')} % 65536 AS INT) AS bucket
       FROM (SELECT prefix, unnest({S.word_tokens('prefix')}) AS tok FROM (SELECT DISTINCT prefix FROM fx_test))),
pw0 AS (SELECT prefix, bucket, CAST(coalesce(df, 0) AS BIGINT) AS df,
               ln((n + 1.0) / (coalesce(df, 0) + 0.5)) AS idf
        FROM pb LEFT JOIN bdf USING (bucket), hstats),
pw1 AS (SELECT *, idf / sum(idf) OVER (PARTITION BY prefix) AS q_weight FROM pw0),
pw AS (SELECT *, q_weight / (sqrt(sum(q_weight * q_weight) OVER (PARTITION BY prefix)) + 1e-10) AS q_weight_l2 FROM pw1)
"""


def _hashed(spark, d):
    return L.bm25_hashed_fit(fx.fx_pool(spark, d), "query")


@register("bm25_hashed_fit", fx.with_fx("fx_pool")[:-1] + _HASHED_CTE
          + "SELECT bucket, df, CAST(n AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl FROM bdf, hstats")
def q_bm25_hashed_fit(spark, d):
    m = _hashed(spark, d)
    return m.bucket_df.select("bucket", "df", F.lit(m.n_docs).cast("bigint").alias("n_docs"),
                              F.lit(round(m.avgdl, 6)).alias("avgdl"))


@register("bm25_hashed_doc_weights", fx.with_fx("fx_pool")[:-1] + _HASHED_CTE
          + "SELECT query, bucket, round(w, 6) AS w FROM dw")
def q_bm25_hashed_doc_weights(spark, d):
    return _hashed(spark, d).doc_weights.select("query", "bucket", F.round("w", 6).alias("w"))


@register("bm25_hashed_query_weights", fx.with_fx("fx_pool", "fx_test")[:-1] + _HASHED_CTE
          + "SELECT prefix, bucket, df, round(idf, 6) AS idf, round(q_weight, 6) AS q_weight, "
            "round(q_weight_l2, 6) AS q_weight_l2 FROM pw")
def q_bm25_hashed_query_weights(spark, d):
    qw = L.bm25_hashed_query_weights(_hashed(spark, d), fx.fx_test(spark, d))
    return qw.select("prefix", "bucket", "df", *[F.round(c, 6).alias(c) for c in ("idf", "q_weight", "q_weight_l2")])


@register("sparse_dot_scores", fx.with_fx("fx_pool", "fx_test")[:-1] + _HASHED_CTE
          + "SELECT prefix, query AS candidate, round(sum(q_weight * w), 6) AS sparse_score "
            "FROM pw JOIN dw USING (bucket) GROUP BY prefix, query")
def q_sparse_dot_scores(spark, d):
    m = _hashed(spark, d)
    s = L.sparse_dot_scores(L.bm25_hashed_query_weights(m, fx.fx_test(spark, d)), m)
    return s.select("prefix", "candidate", F.round("sparse_score", 6).alias("sparse_score"))
