"""Registered queries: Track A cascade and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import candidates as C
from ..operators import fuzzy as FZ
from ..operators import prefix as R
from ..operators import topk as W
from ..session import cut, shared
from ..sources import fixtures as fx
from . import sqlfrag as S
from . import track_a as TA
from .q_text import _J1_SQL, _LINEAR
from .registry import register

K = TA.TOP_K

# ----------------------------------------------------------------- oracle SQL

_BASE = fx.with_fx("fx_train", "fx_test", "fx_pool", "fx_query_features") + f"""
, sc0 AS (SELECT query, query_clean, {_LINEAR} AS popularity_score FROM
          (SELECT query, query_clean, coalesce(orders, 0) AS orders, coalesce(volume, 0) AS volume,
                  coalesce(catalog_clicks, 0) AS catalog_clicks, coalesce(catalog_views, 0) AS catalog_views
           FROM ({_J1_SQL}))),
scored AS (SELECT query, query_clean, popularity_score,
                  CASE WHEN m > 0 THEN popularity_score / m ELSE 0e0 END AS popularity_norm
           FROM sc0, (SELECT max(popularity_score) AS m FROM sc0)),
pop AS (SELECT query_clean, max(popularity_score) AS popularity_score, max(popularity_norm) AS popularity_norm
        FROM scored GROUP BY 1),
tp AS (SELECT DISTINCT {S.norm('prefix')} AS prefix_clean FROM fx_test),
idx AS (SELECT * FROM (SELECT prefix_key, query_clean, popularity_norm,
          CAST(row_number() OVER (PARTITION BY prefix_key ORDER BY popularity_norm DESC, query_clean) AS INT) AS pos
          FROM (SELECT substr(query_clean, 1, i) AS prefix_key, query_clean, popularity_norm
                FROM pop, unnest(range(1, least(length(query_clean), (SELECT max(length(prefix_clean)) FROM tp)) + 1)) AS u(i)
                WHERE length(query_clean) > 0))
        WHERE pos <= {2 * K}),
hist AS (SELECT {S.norm('prefix')} AS prefix_clean, {S.norm('query')} AS query_clean, CAST(count(*) AS BIGINT) AS freq
         FROM fx_train GROUP BY 1, 2),
s1 AS (SELECT prefix_clean, query_clean, sum(score) AS score FROM (
         SELECT prefix_clean, query_clean, freq * 100e0 AS score FROM tp JOIN hist USING (prefix_clean)
         UNION ALL SELECT prefix_clean, query_clean, 50e0 + popularity_norm * 20e0 FROM (
           SELECT tp.prefix_clean, idx.query_clean, idx.popularity_norm
           FROM tp JOIN idx ON idx.prefix_key = tp.prefix_clean AND idx.pos <= {2 * K}
           UNION SELECT tp.prefix_clean, pop.query_clean, pop.popularity_norm FROM tp JOIN hist USING (prefix_clean)
           JOIN pop ON pop.query_clean = hist.query_clean
           WHERE length(tp.prefix_clean) > 0 AND starts_with(pop.query_clean, tp.prefix_clean))) GROUP BY 1, 2),
n1 AS (SELECT tp.prefix_clean, coalesce(c.n, 0) AS n_cands FROM tp
       LEFT JOIN (SELECT prefix_clean, count(*) AS n FROM s1 GROUP BY 1) c USING (prefix_clean)
       WHERE coalesce(c.n, 0) < {K}),
lv AS (SELECT prefix_clean, n_cands, length(prefix_clean) AS plen, lvl, substr(prefix_clean, 1, lvl) AS prefix_key
       FROM n1, unnest(range(length(prefix_clean), 1, -1)) AS u(lvl) WHERE length(prefix_clean) >= 2),
hits0 AS (SELECT lv.prefix_clean, lv.n_cands, lv.plen, lv.lvl, idx.query_clean, idx.popularity_norm
          FROM lv JOIN idx ON idx.prefix_key = lv.prefix_key AND idx.pos <= {2 * K}
          WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.prefix_clean = lv.prefix_clean AND s1.query_clean = idx.query_clean)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix_clean, query_clean ORDER BY lvl DESC) AS r
         FROM hits0) WHERE r = 1),
perlv AS (SELECT prefix_clean, lvl, count(*) AS n_new, any_value(n_cands) AS n_cands FROM hits GROUP BY 1, 2),
keep AS (SELECT prefix_clean, lvl FROM (SELECT *, n_cands + coalesce(sum(n_new) OVER (PARTITION BY prefix_clean
           ORDER BY lvl DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM perlv)
         WHERE before < {K}),
s2 AS (SELECT prefix_clean, query_clean, 25e0 * lvl / plen + popularity_norm * 10e0 AS score
       FROM hits JOIN keep USING (prefix_clean, lvl)),
c2 AS (SELECT prefix_clean, query_clean, score, 1 AS stage FROM s1
       UNION ALL SELECT prefix_clean, query_clean, score, 2 FROM s2),
n2 AS (SELECT tp.prefix_clean FROM tp LEFT JOIN (SELECT prefix_clean, count(*) AS n FROM c2 GROUP BY 1) c
       USING (prefix_clean) WHERE coalesce(c.n, 0) < {K}),
popular AS (SELECT query_clean, max(popularity_score) AS popularity_score FROM
            scored GROUP BY 1),
"""


def _fuzzy_sql(src: str) -> str:
    return f"""(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY prefix_clean
      ORDER BY fuzzy_score DESC, popularity_score DESC, query_clean) AS INT) AS rank FROM (
      SELECT x.prefix_clean, p.query_clean, p.popularity_score, round(100e0 * (1e0 - list_min(list_transform(
               range(1, greatest(length(p.query_clean) - length(x.prefix_clean) + 1, 1) + 1),
               lambda i: levenshtein(x.prefix_clean, substr(p.query_clean, i, length(x.prefix_clean)))))
               / length(x.prefix_clean)), 6) AS fuzzy_score
      FROM {src} x, popular p WHERE length(x.prefix_clean) > 0) WHERE fuzzy_score >= 60)
    WHERE rank <= {K})"""


def _fuzzy_out(src: str) -> str:
    return f"(SELECT prefix_clean, query_clean, fuzzy_score, rank FROM {_fuzzy_sql(src)})"


_REST = f"""fz AS {_fuzzy_out('n2')},
s3 AS (SELECT fz.prefix_clean, fz.query_clean,
              fuzzy_score / 100e0 * 30e0 + coalesce(pop.popularity_norm, 0e0) * 10e0 AS score
       FROM fz LEFT JOIN pop USING (query_clean)
       WHERE NOT EXISTS (SELECT 1 FROM c2 WHERE c2.prefix_clean = fz.prefix_clean AND c2.query_clean = fz.query_clean)),
c3 AS (SELECT * FROM c2 UNION ALL SELECT prefix_clean, query_clean, score, 3 FROM s3),
n3 AS (SELECT tp.prefix_clean, coalesce(c.n, 0) AS n_cands FROM tp
       LEFT JOIN (SELECT prefix_clean, count(*) AS n FROM c3 GROUP BY 1) c USING (prefix_clean)
       WHERE coalesce(c.n, 0) < {K}),
plist AS (SELECT query_clean, popularity_norm, row_number() OVER (ORDER BY popularity_score DESC, query_clean, query) AS r
          FROM (SELECT * FROM scored ORDER BY popularity_score DESC, query_clean, query LIMIT {2 * K})),
fb0 AS (SELECT n3.prefix_clean, n3.n_cands, plist.r, plist.query_clean, plist.popularity_norm FROM n3, plist
        WHERE NOT EXISTS (SELECT 1 FROM c3 WHERE c3.prefix_clean = n3.prefix_clean AND c3.query_clean = plist.query_clean)),
fb1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix_clean, query_clean ORDER BY r) AS f FROM fb0)
        WHERE f = 1),
s4 AS (SELECT prefix_clean, query_clean, popularity_norm * 5e0 AS score FROM
       (SELECT *, row_number() OVER (PARTITION BY prefix_clean ORDER BY r) AS nn FROM fb1) WHERE nn <= {2 * K} - n_cands),
allc AS (SELECT prefix_clean, query_clean, round(score, 6) AS score, stage FROM
         (SELECT * FROM c3 UNION ALL SELECT prefix_clean, query_clean, score, 4 FROM s4)),
top AS (SELECT * FROM (SELECT prefix_clean, query_clean, score, stage, CAST(row_number() OVER (PARTITION BY prefix_clean
        ORDER BY score DESC, query_clean) AS INT) AS rank FROM allc) WHERE rank <= {K}),
cnt AS (SELECT prefix_clean, count(*) AS n FROM top GROUP BY 1 HAVING count(*) < {K}),
fill AS (SELECT query_clean, row_number() OVER (ORDER BY h, query_clean) AS fr FROM
         (SELECT query_clean, md5('42|' || query_clean) AS h FROM (SELECT DISTINCT query_clean FROM scored)
          ORDER BY h, query_clean LIMIT {2 * K})),
bf0 AS (SELECT cnt.prefix_clean, cnt.n, fill.fr, fill.query_clean FROM cnt, fill
        WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.prefix_clean = cnt.prefix_clean AND top.query_clean = fill.query_clean)),
bf AS (SELECT prefix_clean, query_clean, CAST(n + i AS INT) AS rank, 5 AS stage FROM
       (SELECT *, row_number() OVER (PARTITION BY prefix_clean ORDER BY fr) AS i FROM bf0) WHERE i <= {K} - n),
ranked AS (SELECT prefix_clean, query_clean, rank, stage FROM top UNION ALL SELECT * FROM bf)
"""

_TA = _BASE + _REST


def _inputs(spark, d):
    return fx.inputs(spark, d)


def _a(spark, d):
    i = _inputs(spark, d)
    return i, TA.build(i["train"], i["pool"], i["features"], i["test"])


def _cascade(spark, d):
    """The cascade's candidates and ranked lists, run once per session and input."""
    def run():
        i, a = _a(spark, d)
        c = cut(TA.cascade_candidates(a, _tp(i["test"]), K))
        return c, cut(TA.rank_candidates(a, c, K))
    return shared(spark, "cascade", [f"{d}/{t}.parquet" for t in ("part", "lineitem")], run)


def _tp(test):
    return (test.select(normalize_text("prefix").alias("prefix_clean"))
            .distinct())


@register("prefix_index", _TA + "SELECT prefix_key, query_clean, round(popularity_norm, 6) AS popularity_norm, pos FROM idx")
def q_prefix_index(spark, d):
    _, a = _a(spark, d)
    return a.index.select("prefix_key", "query_clean", F.round("popularity_norm", 6).alias("popularity_norm"), "pos")


@register("prefix_match", _TA + f"""SELECT tp.prefix_clean, idx.query_clean, round(50e0 + idx.popularity_norm * 20e0, 6) AS score
FROM tp JOIN idx ON idx.prefix_key = tp.prefix_clean AND idx.pos <= {2 * K}""")
def q_prefix_match(spark, d):
    i, a = _a(spark, d)
    m = R.prefix_match(_tp(i["test"]), a.index, K)
    return m.select("prefix_clean", "query_clean", F.round("score", 6).alias("score"))


@register("prefix_backoff", _TA + "SELECT prefix_clean, query_clean, round(score, 6) AS score FROM s2")
def q_prefix_backoff(spark, d):
    i, a = _a(spark, d)
    p = _tp(i["test"])
    s1 = R.history_and_match(p, a.history, a.popularity, a.index, K)
    s2 = R.prefix_backoff(R.needy(p, s1, K), s1, a.index, K)
    return s2.select("prefix_clean", "query_clean", F.round("score", 6).alias("score"))


@register("fuzzy_window_levenshtein", _TA + "SELECT * FROM " + _fuzzy_out("tp"))
def q_fuzzy_window_levenshtein(spark, d):
    i, a = _a(spark, d)
    return FZ.fuzzy_window_levenshtein(_tp(i["test"]), a.popular, limit=K)


@register("fuzzy_partial_ratio")
def q_fuzzy_partial_ratio(spark, d):
    i, a = _a(spark, d)
    return FZ.fuzzy_partial_ratio(_tp(i["test"]), a.popular, limit=K)


@register("fuzzy_popular_subset", _TA + "SELECT query_clean, popularity_score FROM popular")
def q_fuzzy_popular_subset(spark, d):
    return _a(spark, d)[1].popular


@register("popularity_fallback", _TA + "SELECT prefix_clean, query_clean, round(score, 6) AS score FROM s4")
def q_popularity_fallback(spark, d):
    return _cascade(spark, d)[0].where("stage = 4").select("prefix_clean", "query_clean", "score")


@register("topk_per_prefix", _TA + "SELECT prefix_clean, query_clean, score, stage, rank FROM top")
def q_topk_per_prefix(spark, d):
    c = _cascade(spark, d)[0].withColumnRenamed("query_clean", "candidate")
    return (W.topk_per_key(c, "prefix_clean", "score", K)
            .select("prefix_clean", F.col("candidate").alias("query_clean"), "score", "stage", "rank"))


@register("backfill_random", _TA + "SELECT prefix_clean, query_clean, rank FROM bf")
def q_backfill_random(spark, d):
    """The fill of the whole cascade's lists."""
    return _cascade(spark, d)[1].where("stage = 5").select("prefix_clean", "query_clean", "rank")


@register("cascade_topk", _TA + f"""SELECT t.prefix, r.rank, r.query_clean AS query
FROM fx_test t JOIN ranked r ON r.prefix_clean = {S.norm('t.prefix')}""")
def q_cascade_topk(spark, d):
    i = _inputs(spark, d)
    sub = TA.cascade_topk(i["train"], i["test"], i["pool"], i["features"], K)
    return sub.select("prefix", F.posexplode("retrieved_queries").alias("pos", "query")) \
        .select("prefix", (F.col("pos") + 1).cast("int").alias("rank"), "query")


@register("cascade_topk_partial_ratio")
def q_cascade_topk_partial_ratio(spark, d):
    i = _inputs(spark, d)
    sub = TA.cascade_topk(i["train"], i["test"], i["pool"], i["features"], K, fuzzy="partial_ratio")
    return sub.select("prefix", F.posexplode("retrieved_queries").alias("pos", "query")) \
        .select("prefix", (F.col("pos") + 1).cast("int").alias("rank"), "query")


@register("collect_ranked_list", _TA + """SELECT prefix_clean, CAST(count(*) AS INT) AS n_items,
  string_agg(query_clean, '|' ORDER BY rank) AS items FROM ranked GROUP BY prefix_clean""")
def q_collect_ranked_list(spark, d):
    ranked = _cascade(spark, d)[1].withColumnRenamed("query_clean", "candidate")
    lists = W.collect_ranked_list(ranked, "prefix_clean")
    return lists.select("prefix_clean", F.size("retrieved_queries").alias("n_items"),
                        F.array_join("retrieved_queries", "|").alias("items"))


@register("strategy_contribution", _TA + """SELECT stage, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(DISTINCT prefix_clean) AS BIGINT) AS n_prefixes FROM ranked GROUP BY stage""")
def q_strategy_contribution(spark, d):
    ranked = _cascade(spark, d)[1]
    return ranked.groupBy("stage").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.countDistinct("prefix_clean").alias("n_prefixes"))


@register("submission_validation", _TA + f"""
, sub AS (SELECT t.prefix, (SELECT count(*) FROM ranked r WHERE r.prefix_clean = {S.norm('t.prefix')}) AS n FROM fx_test t)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST((SELECT count(*) FROM fx_test) AS BIGINT) AS n_expected,
       CAST(min(n) AS INT) AS min_len, CAST(max(n) AS INT) AS max_len, round(avg(n), 6) AS mean_len,
       bool_and(n = {K}) AS all_k,
       CAST((SELECT count(*) FROM (SELECT DISTINCT prefix FROM fx_test) e
             WHERE e.prefix NOT IN (SELECT prefix FROM sub)) AS BIGINT) AS n_missing FROM sub""")
def q_submission_validation(spark, d):
    from ..operators.evaluate import submission_validation
    test = fx.fx_test(spark, d)
    return submission_validation(cut(TA.submission(test, _cascade(spark, d)[1])), test, K)


# ----------------------------------------------------------- lookups & coverage

@register("history_lookup", _TA + f"""SELECT t.prefix, h.prefix_clean, h.query_clean, h.freq
FROM fx_test t JOIN hist h ON h.prefix_clean = {S.norm('t.prefix')}""")
def q_history_lookup(spark, d):
    i, a = _a(spark, d)
    return C.history_lookup(i["test"], a.history).select("prefix", "prefix_clean", "query_clean", "freq")


def _coverage_sql(col: str, table: str) -> str:
    return (f"SELECT CAST(count(*) AS BIGINT) AS n_test, CAST(count(k.kk) AS BIGINT) AS n_covered, "
            f"round(count(k.kk) / count(*), 6) AS coverage FROM fx_test t "
            f"LEFT JOIN (SELECT DISTINCT {col} AS kk FROM {table}) k ON k.kk = {S.norm('t.prefix')}")


@register("history_coverage", _TA + _coverage_sql("prefix_clean", "hist"))
def q_history_coverage(spark, d):
    i, a = _a(spark, d)
    c = C.key_coverage(i["test"], a.history)
    return c.select("n_test", "n_covered", F.round("coverage", 6).alias("coverage"))


@register("prefix_index_coverage", _TA + _coverage_sql("prefix_key", "idx"))
def q_prefix_index_coverage(spark, d):
    i, a = _a(spark, d)
    c = C.key_coverage(i["test"], a.index.select(F.col("prefix_key").alias("prefix_clean")))
    return c.select("n_test", "n_covered", F.round("coverage", 6).alias("coverage"))


@register("missing_prefixes", _TA + f"""SELECT DISTINCT t.prefix FROM fx_test t
WHERE t.prefix NOT IN (SELECT t2.prefix FROM fx_test t2 JOIN hist h ON h.prefix_clean = {S.norm('t2.prefix')})""")
def q_missing_prefixes(spark, d):
    i, a = _a(spark, d)
    return C.missing_prefixes(i["test"], C.history_lookup(i["test"], a.history))


# ----------------------------------------------------------- generic top-k ops

@register("head_n", fx.with_fx("fx_pool") + "SELECT query FROM fx_pool ORDER BY query LIMIT 100")
def q_head_n(spark, d):
    return W.head_n(fx.fx_pool(spark, d), 100, [F.col("query").asc()])


@register("cap_postings", _TA + f"""SELECT * FROM (SELECT prefix_clean, query_clean, freq,
  CAST(row_number() OVER (PARTITION BY prefix_clean ORDER BY freq DESC, query_clean) AS INT) AS pos FROM hist)
WHERE pos <= {K}""")
def q_cap_postings(spark, d):
    _, a = _a(spark, d)
    return W.cap_postings(a.history, "prefix_clean", K, [F.col("freq").desc(), F.col("query_clean").asc()])


# Sizes of the reduced pool.
REDUCE_TOP, REDUCE_RANDOM = 560_000, 140_000


@register("reduce_pool", _TA + f"""SELECT DISTINCT * FROM (
 (SELECT query_clean, popularity_score, round(popularity_norm, 6) AS popularity_norm FROM scored
  ORDER BY popularity_score DESC, query_clean LIMIT {REDUCE_TOP})
 UNION ALL
 (SELECT query_clean, popularity_score, round(popularity_norm, 6) FROM scored
  ORDER BY md5('42|' || query_clean), query_clean LIMIT {REDUCE_RANDOM}))""")
def q_reduce_pool(spark, d):
    _, a = _a(spark, d)
    s = a.scored.select("query_clean", "popularity_score", F.round("popularity_norm", 6).alias("popularity_norm"))
    return W.reduce_pool(s, "popularity_score", REDUCE_TOP, REDUCE_RANDOM, 42, "query_clean")


@register("distinct_queries", _TA + "SELECT DISTINCT query_clean FROM scored")
def q_distinct_queries(spark, d):
    return W.distinct_queries(_a(spark, d)[1].scored)
