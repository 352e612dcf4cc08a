"""Registered queries: text functions (T1-T9), popularity (P1-P5), J1, J2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import popularity as P
from ..operators import profile as G
from ..operators.topk import topk_per_key, collect_ranked_list
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import sqlfrag as S
from .registry import register
from .track_a import TOP_K


def _docs(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text")


@register("normalize_text", f"SELECT doc_id, {S.norm('text')} AS text_norm FROM documents")
def q_normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", TX.normalize_text("text").alias("text_norm"))


@register("clean_query", f"SELECT doc_id, {S.clean('text')} AS text_clean FROM documents")
def q_clean_query(spark, d):
    return _docs(spark, d).select("doc_id", TX.clean_query("text").alias("text_clean"))


def _gram_summary_sql(table: str, n_lit: str) -> str:
    return (f"SELECT doc_id, {n_lit} AS n, CAST(len(g) AS INT) AS n_grams, "
            f"md5(array_to_string(g, '|')) AS grams_md5 FROM {table}")


def _gram_summary(df, n):
    return df.select("doc_id", F.lit(n).alias("n"), F.size("g").alias("n_grams"),
                     F.md5(F.array_join("g", "|")).alias("grams_md5"))


@register("char_ngrams", " UNION ALL ".join(
    _gram_summary_sql(S.grams_table("documents", "doc_id", "text", n, "g"), str(n)) for n in (2, 3, 4)))
def q_char_ngrams(spark, d):
    docs = _docs(spark, d)
    out = None
    for n in (2, 3, 4):
        part = _gram_summary(TX.add_char_ngrams(docs, "text", "g", n), n)
        out = part if out is None else out.unionByName(part)
    return out


_STRICT = ("(SELECT doc_id, CASE WHEN length(t) < 3 THEN []::VARCHAR[] ELSE "
           "list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) END AS g "
           "FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")


@register("char_trigrams_strict", _gram_summary_sql(_STRICT, "3"))
def q_char_trigrams_strict(spark, d):
    return _gram_summary(TX.add_char_ngrams(_docs(spark, d), "text", "g", 3, strict=True), 3)


@register("word_tokens", f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 "
                         f"FROM (SELECT doc_id, {S.word_tokens('text')} AS t FROM documents)")
def q_word_tokens(spark, d):
    t = TX.word_tokens("text")
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"),
                                  F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@register("drop_missing_pairs", fx.with_fx("fx_train")
          + "SELECT prefix, query FROM fx_train WHERE prefix IS NOT NULL AND query IS NOT NULL")
def q_drop_missing_pairs(spark, d):
    return fx.fx_train(spark, d).dropna(subset=["prefix", "query"])


@register("guard_empty_prefix", fx.with_fx("fx_train") + f"""
, hist AS (SELECT {S.norm('prefix')} AS prefix_clean, {S.norm('query')} AS query_clean, count(*) AS freq
           FROM fx_train GROUP BY 1, 2),
top AS (SELECT prefix_clean, query_clean, row_number() OVER (PARTITION BY prefix_clean ORDER BY freq DESC, query_clean) AS r
        FROM hist),
lists AS (SELECT prefix_clean, list(query_clean ORDER BY r) AS l FROM top WHERE r <= {TOP_K} GROUP BY 1),
t AS (SELECT DISTINCT prefix FROM fx_train)
SELECT coalesce(t.prefix, '') AS prefix,
       CAST(len(coalesce(CASE WHEN coalesce(t.prefix, '') = '' THEN NULL ELSE l END, [])) AS INT) AS n_items,
       array_to_string(coalesce(CASE WHEN coalesce(t.prefix, '') = '' THEN NULL ELSE l END, []), '|') AS items
FROM t LEFT JOIN lists ON lists.prefix_clean = {S.norm('t.prefix')}""")
def q_guard_empty_prefix(spark, d):
    from ..operators.candidates import guard_empty_prefix
    train = fx.fx_train(spark, d)
    hist = G.prefix_query_freq(train).withColumnRenamed("query_clean", "candidate")
    lists = collect_ranked_list(topk_per_key(hist, "prefix_clean", "freq", TOP_K), "prefix_clean")
    out = guard_empty_prefix(train.select("prefix").distinct(), lists)
    return out.select("prefix", F.size("retrieved_queries").alias("n_items"),
                      F.array_join("retrieved_queries", "|").alias("items"))


_J2_SQL = ("SELECT p.query, f.orders, f.volume, f.catalog_clicks, f.catalog_views "
           "FROM fx_pool p LEFT JOIN fx_query_features f ON p.query = f.query")
_J1_SQL = (f"SELECT p.query, {S.norm('p.query')} AS query_clean, f.orders, f.volume, f.catalog_clicks, f.catalog_views "
           f"FROM fx_pool p LEFT JOIN (SELECT {S.norm('query')} AS qc, orders, volume, catalog_clicks, catalog_views "
           f"FROM fx_query_features) f ON {S.norm('p.query')} = f.qc")
_FILL = ("SELECT query, coalesce(orders, 0) AS orders, coalesce(volume, 0) AS volume, "
         "coalesce(catalog_clicks, 0) AS catalog_clicks, coalesce(catalog_views, 0) AS catalog_views")
_LINEAR = ("(10e0 * orders + 5e0 * volume + 2e0 * catalog_clicks + 1e0 * catalog_views)")


# Unmatched rows carry nulls; the integer counts come out as DOUBLE so that a
# nullable column has one representation in every client.
_NULLABLE = ["orders", "catalog_clicks", "catalog_views"]


def _as_double(df):
    return df.select(*[F.col(c).cast("double").alias(c) if c in _NULLABLE else F.col(c) for c in df.columns])


def _as_double_sql(inner: str, keys: str) -> str:
    return (f"SELECT {keys}, CAST(orders AS DOUBLE) AS orders, volume, CAST(catalog_clicks AS DOUBLE) AS catalog_clicks, "
            f"CAST(catalog_views AS DOUBLE) AS catalog_views FROM ({inner})")


@register("enrich_pool_normalized", fx.with_fx("fx_pool", "fx_query_features")
          + _as_double_sql(_J1_SQL, "query, query_clean"))
def q_enrich_pool_normalized(spark, d):
    return _as_double(P.enrich_pool_normalized(fx.fx_pool(spark, d), fx.fx_query_features(spark, d)))


@register("enrich_pool_raw", fx.with_fx("fx_pool", "fx_query_features") + _as_double_sql(_J2_SQL, "query"))
def q_enrich_pool_raw(spark, d):
    return _as_double(P.enrich_pool_raw(fx.fx_pool(spark, d), fx.fx_query_features(spark, d)))


@register("fill_missing_zero", fx.with_fx("fx_pool", "fx_query_features")
          + _FILL + f" FROM ({_J2_SQL})")
def q_fill_missing_zero(spark, d):
    return P.fill_missing_zero(P.enrich_pool_raw(fx.fx_pool(spark, d), fx.fx_query_features(spark, d)))


_SCORED_SQL = (f"SELECT query, query_clean, {_LINEAR} AS popularity_score FROM "
               f"(SELECT query, query_clean, coalesce(orders, 0) AS orders, coalesce(volume, 0) AS volume, "
               f"coalesce(catalog_clicks, 0) AS catalog_clicks, coalesce(catalog_views, 0) AS catalog_views "
               f"FROM ({_J1_SQL}))")
_NORM_SQL = (f"SELECT query, query_clean, popularity_score, CASE WHEN m > 0 THEN round(popularity_score / m, 6) "
             f"ELSE 0e0 END AS popularity_norm FROM ({_SCORED_SQL}), "
             f"(SELECT max(popularity_score) AS m FROM ({_SCORED_SQL}))")


def _scored(spark, d):
    e = P.fill_missing_zero(P.enrich_pool_normalized(fx.fx_pool(spark, d), fx.fx_query_features(spark, d)),
                            P.FEATURES)
    return P.popularity_linear(e)


@register("popularity_linear", fx.with_fx("fx_pool", "fx_query_features") + _SCORED_SQL)
def q_popularity_linear(spark, d):
    return _scored(spark, d).select("query", "query_clean", "popularity_score")


@register("popularity_max_norm", fx.with_fx("fx_pool", "fx_query_features") + _NORM_SQL)
def q_popularity_max_norm(spark, d):
    s = P.popularity_max_norm(_scored(spark, d))
    return s.select("query", "query_clean", "popularity_score", F.round("popularity_norm", 6).alias("popularity_norm"))


@register("prune_columns", fx.with_fx("fx_pool", "fx_query_features")
          + f"SELECT query_clean, popularity_score, popularity_norm FROM ({_NORM_SQL})")
def q_prune_columns(spark, d):
    s = P.scored_pool(fx.fx_pool(spark, d), fx.fx_query_features(spark, d))
    return s.select("query_clean", "popularity_score", F.round("popularity_norm", 6).alias("popularity_norm"))


_MAXNORM_SQL = ("SELECT query, " + ", ".join(
    f"CASE WHEN m_{c} > 0 THEN {c} / m_{c} ELSE 0e0 END AS {c}_norm" for c in P.FEATURES)
    + f" FROM ({_FILL} FROM ({_J2_SQL})), (SELECT "
    + ", ".join(f"max({c}) AS m_{c}" for c in P.FEATURES) + f" FROM ({_FILL} FROM ({_J2_SQL})))")


@register("feature_max_norm", fx.with_fx("fx_pool", "fx_query_features") + "SELECT query, " + ", ".join(
    f"round({c}_norm, 6) AS {c}_norm" for c in P.FEATURES) + f" FROM ({_MAXNORM_SQL})")
def q_feature_max_norm(spark, d):
    e = P.feature_max_norm(P.fill_missing_zero(P.enrich_pool_raw(fx.fx_pool(spark, d), fx.fx_query_features(spark, d))))
    return e.select("query", *[F.round(f"{c}_norm", 6).alias(f"{c}_norm") for c in P.FEATURES])


@register("popularity_weighted", fx.with_fx("fx_pool", "fx_query_features")
          + "SELECT query, round(0.4e0 * orders_norm + 0.3e0 * catalog_clicks_norm + 0.2e0 * volume_norm "
            f"+ 0.1e0 * catalog_views_norm, 6) AS popularity_score FROM ({_MAXNORM_SQL})")
def q_popularity_weighted(spark, d):
    s = P.hybrid_pool_popularity(fx.fx_pool(spark, d), fx.fx_query_features(spark, d))
    return s.select("query", F.round("popularity_score", 6).alias("popularity_score"))


# Twice the 150-long output list: the size of the fallback popular list.
TOP_POPULAR_N = 300


@register("top_popular", fx.with_fx("fx_pool", "fx_query_features")
          + f"SELECT query, query_clean, popularity_score FROM ({_SCORED_SQL}) "
            f"ORDER BY popularity_score DESC, query_clean, query LIMIT {TOP_POPULAR_N}")
def q_top_popular(spark, d):
    s = _scored(spark, d)
    return (s.orderBy(F.col("popularity_score").desc(), "query_clean", "query").limit(TOP_POPULAR_N)
            .select("query", "query_clean", "popularity_score"))
