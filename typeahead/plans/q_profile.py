"""Registered queries: profiling and aggregations (G1-G14, G16-G19), H1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import popularity as P
from ..operators import profile as G
from ..operators.topk import fixed_size_sample
from ..sources import fixtures as fx
from ..functions.text import add_char_ngrams, normalize_text
from . import sqlfrag as S
from .registry import register

_ALL = fx.with_fx("fx_train", "fx_test", "fx_pool", "fx_query_features")


@register("prefix_query_freq", fx.with_fx("fx_train")
          + f"SELECT {S.norm('prefix')} AS prefix_clean, {S.norm('query')} AS query_clean, "
            "CAST(count(*) AS BIGINT) AS freq FROM fx_train GROUP BY 1, 2")
def q_prefix_query_freq(spark, d):
    return G.prefix_query_freq(fx.fx_train(spark, d))


@register("mean_queries_per_prefix", fx.with_fx("fx_train")
          + f"SELECT CAST(count(*) AS BIGINT) AS n_prefixes, round(avg(n), 6) AS mean_queries FROM "
            f"(SELECT {S.norm('prefix')} AS p, count(*) AS n FROM fx_train GROUP BY 1)")
def q_mean_queries_per_prefix(spark, d):
    r = G.mean_queries_per_prefix(fx.fx_train(spark, d))
    return r.select("n_prefixes", F.round("mean_queries", 6).alias("mean_queries"))


def _vc_sql(col):
    return (f"(SELECT '{col}' AS column_name, {col} AS value, CAST(count(*) AS BIGINT) AS n FROM fx_train "
            f"WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY n DESC, value LIMIT 20)")


@register("value_counts_topn", fx.with_fx("fx_train") + _vc_sql("prefix") + " UNION ALL " + _vc_sql("query"))
def q_value_counts_topn(spark, d):
    t = fx.fx_train(spark, d)
    return reduce(DataFrame.unionByName,
                  [G.value_counts_topn(t, c, 20).select(F.lit(c).alias("column_name"), "value", "n")
                   for c in ("prefix", "query")])


_DISTINCT_SPEC = [("train", "prefix", "fx_train"), ("train", "query", "fx_train"),
                  ("pool", "query", "fx_pool"), ("test", "prefix", "fx_test")]


@register("distinct_counts", _ALL + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM {v}"
    for t, c, v in _DISTINCT_SPEC))
def q_distinct_counts(spark, d):
    ins = fx.inputs(spark, d)
    return G.distinct_counts({f"{t}": (ins[t], c) for t, c, _ in _DISTINCT_SPEC[:1]}) \
        .unionByName(G.distinct_counts({"train": (ins["train"], "query")})) \
        .unionByName(G.distinct_counts({"pool": (ins["pool"], "query")})) \
        .unionByName(G.distinct_counts({"test": (ins["test"], "prefix")}))


_NULL_SPEC = {"train": ("fx_train", ["prefix", "query"]), "test": ("fx_test", ["prefix"]),
              "pool": ("fx_pool", ["query"]),
              "features": ("fx_query_features", ["query"] + P.FEATURES)}


@register("null_counts", _ALL + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM {v}"
    for t, (v, cols) in _NULL_SPEC.items() for c in cols))
def q_null_counts(spark, d):
    ins = fx.inputs(spark, d)
    return reduce(DataFrame.unionByName, [G.null_counts(ins[t], t) for t in _NULL_SPEC])


_LEN_SPEC = [("train", "prefix", "fx_train"), ("train", "query", "fx_train"),
             ("test", "prefix", "fx_test"), ("pool", "query", "fx_pool")]


@register("length_stats", _ALL + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, round(avg(length({c})), 6) AS mean_len, "
    f"CAST(median(length({c})) AS DOUBLE) AS median_len, CAST(min(length({c})) AS BIGINT) AS min_len, "
    f"CAST(max(length({c})) AS BIGINT) AS max_len FROM {v}" for t, c, v in _LEN_SPEC))
def q_length_stats(spark, d):
    ins = fx.inputs(spark, d)
    parts = [G.length_stats(ins[t], c).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"),
                                              F.round("mean_len", 6).alias("mean_len"),
                                              F.col("median_len").cast("double").alias("median_len"),
                                              "min_len", "max_len")
             for t, c, _ in _LEN_SPEC]
    return reduce(DataFrame.unionByName, parts)


def _describe_sql(long_sql: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return (f"SELECT {g}column_name, CAST(count(value) AS BIGINT) AS count, round(avg(value), 6) AS mean, "
            "round(stddev_samp(value), 6) AS std, min(value) AS min, "
            "round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, "
            "round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max "
            f"FROM ({long_sql}) WHERE value IS NOT NULL GROUP BY {g}column_name")


def _round_describe(df):
    r = ["mean", "std", "p25", "p50", "p75"]
    return df.select(*[F.round(c, 6).alias(c) if c in r else F.col(c) for c in df.columns])


@register("describe_numeric", fx.with_fx("fx_query_features") + _describe_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM fx_query_features" for c in P.FEATURES)))
def q_describe_numeric(spark, d):
    return _round_describe(G.describe_numeric(fx.fx_query_features(spark, d), P.FEATURES))


@register("describe_by_class", fx.with_fx("fx_scored") + _describe_sql(
    "SELECT target, 'score' AS column_name, score AS value FROM fx_scored", "target"))
def q_describe_by_class(spark, d):
    return _round_describe(G.describe_by_class(fx.fx_scored(spark, d), ["score"], "target"))


@register("prefix_length_distribution", fx.with_fx("fx_test") + _describe_sql(
    "SELECT 'prefix_length' AS column_name, CAST(length(prefix) AS DOUBLE) AS value FROM fx_test"))
def q_prefix_length_distribution(spark, d):
    t = fx.fx_test(spark, d).select(F.length("prefix").alias("prefix_length"))
    return _round_describe(G.describe_numeric(t, ["prefix_length"]))


def histogram_sql(src: str, x: str, bins: int = 50, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    on = f"USING ({group})" if group else "ON TRUE"
    mm = f"SELECT {g}min(x) AS lo, max(x) AS hi FROM v" + (f" GROUP BY {group}" if group else "")
    return (f"SELECT {g}bin, CAST(count(*) AS BIGINT) AS n, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / {bins}, 6) AS bin_lo, "
            f"round(any_value(lo) + (bin + 1) * (any_value(hi) - any_value(lo)) / {bins}, 6) AS bin_hi FROM ("
            f"SELECT {g}lo, hi, CAST(CASE WHEN hi > lo THEN least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) "
            f"ELSE 0 END AS INT) AS bin FROM (WITH v AS (SELECT {g}CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL) "
            f"SELECT * FROM v JOIN ({mm}) m {on})) GROUP BY {g}bin")


def round_hist(h):
    return h.select(*[F.round(c, 6).alias(c) if c in ("bin_lo", "bin_hi") else F.col(c) for c in h.columns])


@register("length_histogram", fx.with_fx("fx_pool") + histogram_sql("fx_pool", "length(query)"))
def q_length_histogram(spark, d):
    p = fx.fx_pool(spark, d).select(F.length("query").alias("len"))
    return round_hist(G.histogram(p, "len", 50))


@register("feature_correlation", fx.with_fx("fx_query_features") + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM fx_query_features"
    for a in P.FEATURES for b in P.FEATURES))
def q_feature_correlation(spark, d):
    c = G.feature_correlation(fx.fx_query_features(spark, d), P.FEATURES)
    return c.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


SAMPLE_SEED = 42


@register("length_correlation", fx.with_fx("fx_train")
          + "SELECT CAST(count(*) AS BIGINT) AS n_rows, round(corr(length(prefix), length(query)), 6) AS corr FROM fx_train")
def q_length_correlation(spark, d):
    return fx.fx_train(spark, d).agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.round(F.corr(F.length("prefix"), F.length("query")), 6).alias("corr"))


@register("fixed_size_sample", fx.with_fx("fx_pool")
          + f"SELECT query FROM fx_pool ORDER BY md5('{SAMPLE_SEED}|' || query), query LIMIT 500")
def q_fixed_size_sample(spark, d):
    return fixed_size_sample(fx.fx_pool(spark, d), 500, SAMPLE_SEED, "query")


@register("join_match_rate", fx.with_fx("fx_train", "fx_pool", "fx_query_features") + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, "
    f"CAST(count(f.query) AS BIGINT) AS n_matched, round(count(f.query) / count(*), 6) AS match_rate "
    f"FROM {v} x LEFT JOIN (SELECT DISTINCT query FROM fx_query_features) f ON x.query = f.query"
    for t, v in (("pool", "fx_pool"), ("train", "fx_train"))))
def q_join_match_rate(spark, d):
    ins = fx.inputs(spark, d)
    return reduce(DataFrame.unionByName, [
        G.join_match_rate(ins[t], ins["features"], "query").select(
            F.lit(t).alias("table_name"), "n_rows", "n_matched", F.round("match_rate", 6).alias("match_rate"))
        for t in ("pool", "train")])


@register("trigram_counts", fx.with_fx("fx_pool") + """
, g AS (SELECT CASE WHEN length(t) < 3 THEN []::VARCHAR[] ELSE
          list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) END AS grams
        FROM (SELECT lower(query) AS t FROM fx_pool)),
c AS (SELECT gram, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(grams) AS gram FROM g) GROUP BY gram),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS n_total, CAST(count(*) AS BIGINT) AS n_distinct FROM c)
SELECT gram, n, n_total, n_distinct FROM (SELECT * FROM c ORDER BY n DESC, gram LIMIT 30), tot""")
def q_trigram_counts(spark, d):
    p = add_char_ngrams(fx.fx_pool(spark, d).select(F.lower("query").alias("t")), "t", "g", 3, strict=True)
    c = G.gram_counts(p, F.col("g"))
    n_total, n_distinct = c.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = c.orderBy(F.col("n").desc(), "gram").limit(30)
    return top.select("gram", "n", F.lit(n_total).cast("bigint").alias("n_total"),
                      F.lit(n_distinct).cast("bigint").alias("n_distinct"))


@register("label_balance", fx.with_fx("fx_scored")
          + "SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, "
            "CAST(sum(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg, "
            "CAST(count(DISTINCT doc_id) AS BIGINT) AS n_distinct_doc_id, "
            "round(sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) / count(*), 6) AS pos_share, "
            "round(sum(CASE WHEN target = 0 THEN 1 ELSE 0 END) / count(*), 6) AS neg_share FROM fx_scored")
def q_label_balance(spark, d):
    b = G.label_balance(fx.fx_scored(spark, d), "target", ["doc_id"])
    return b.select("n_total", "n_pos", "n_neg", "n_distinct_doc_id",
                    F.round("pos_share", 6).alias("pos_share"), F.round("neg_share", 6).alias("neg_share"))


@register("dataset_summary", _ALL + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {v}"
    for t, v in (("train", "fx_train"), ("pool", "fx_pool"), ("features", "fx_query_features"), ("test", "fx_test"))))
def q_dataset_summary(spark, d):
    from ..sources.tables import table_profile
    ins = fx.inputs(spark, d)
    return table_profile({t: ins[t] for t in ("train", "pool", "features", "test")}).select("table_name", "n_rows")


@register("insight_rules", _ALL + """
, tr AS (SELECT avg(length(prefix)) / avg(length(query)) AS ratio,
                count(DISTINCT prefix) / count(*) AS p_share, count(DISTINCT query) / count(*) AS q_share FROM fx_train),
cov AS (SELECT count(f.orders) / count(*) AS coverage, count(*) AS n_pool
        FROM fx_pool p LEFT JOIN fx_query_features f ON p.query = f.query)
SELECT 'length_ratio_below_half' AS rule, round(ratio, 6) AS value, ratio < 0.5 AS holds FROM tr
UNION ALL SELECT 'prefixes_repeat', round(p_share, 6), p_share < 0.8 FROM tr
UNION ALL SELECT 'queries_repeat', round(q_share, 6), q_share < 0.8 FROM tr
UNION ALL SELECT 'high_feature_coverage', round(coverage, 6), coverage > 0.8 FROM cov
UNION ALL SELECT 'large_pool', CAST(n_pool AS DOUBLE), n_pool > 10000 FROM cov""")
def q_insight_rules(spark, d):
    ins = fx.inputs(spark, d)
    tr = ins["train"].agg((F.avg(F.length("prefix")) / F.avg(F.length("query"))).alias("ratio"),
                          (F.countDistinct("prefix") / F.count(F.lit(1))).alias("p_share"),
                          (F.countDistinct("query") / F.count(F.lit(1))).alias("q_share"))
    cov = P.enrich_pool_raw(ins["pool"], ins["features"]).agg(
        (F.count("orders") / F.count(F.lit(1))).alias("coverage"), F.count(F.lit(1)).cast("double").alias("n_pool"))

    def rule(df, name, col, cond):
        return df.select(F.lit(name).alias("rule"), F.round(col, 6).alias("value"), cond.alias("holds"))
    return reduce(DataFrame.unionByName, [
        rule(tr, "length_ratio_below_half", F.col("ratio"), F.col("ratio") < 0.5),
        rule(tr, "prefixes_repeat", F.col("p_share"), F.col("p_share") < 0.8),
        rule(tr, "queries_repeat", F.col("q_share"), F.col("q_share") < 0.8),
        rule(cov, "high_feature_coverage", F.col("coverage"), F.col("coverage") > 0.8),
        rule(cov, "large_pool", F.col("n_pool"), F.col("n_pool") > 10000)])


@register("unique_key_check", fx.with_fx("fx_query_features")
          + f"SELECT {S.norm('query')} AS query_clean, CAST(count(*) AS BIGINT) AS n FROM fx_query_features "
            "GROUP BY 1 HAVING count(*) > 1")
def q_unique_key_check(spark, d):
    f = fx.fx_query_features(spark, d).select(normalize_text("query").alias("query_clean"))
    return G.unique_key_check(f, "query_clean")
