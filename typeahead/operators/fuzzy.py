"""Typo-tolerant matching of prefixes against the popular list.

A score depends on the prefix and one *window* of the query only, and queries share
windows.  So each window is kept once, with its best queries in list order (a list of k
needs no more than k of them), and prefixes meet windows, not queries.  Candidates of a
prefix come from an exact blocking on pieces of the windows at offsets that agree within
the allowed edits; no pair that could pass the threshold is lost.  R5 scores them with
Spark's built-in ``levenshtein``.  R4 tests a bound from character counts first, and runs
its scorer, a bit-parallel longest common subsequence over Arrow batches, on the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .ranking import top_n

# Fixed value of the fuzzy stage.
FUZZY_THRESHOLD = 60.0
FUZZY_LIMIT = 150           # the length of the final list


def fuzzy_popular_subset(scored_pool: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct normalised queries among the ``n`` most popular pool rows (None:
    all), with the popularity that ranks them (the list order of the scan)."""
    top = scored_pool if n is None else top_n(scored_pool, [
        F.col("popularity_score").desc(), F.col("query_clean").asc(), F.col("query").asc()], n)
    return top.groupBy("query_clean").agg(F.max("popularity_score").alias("popularity_score"))


def _best(s: DataFrame, popular: DataFrame, limit: int) -> DataFrame:
    """Best ``limit`` per prefix; equal scores keep the popular list's order
    (popularity, then text), as a stable scan of that list would."""
    s = s.join(popular.select("query_clean", "popularity_score"), "query_clean")
    w = Window.partitionBy("prefix_clean").orderBy(F.col("fuzzy_score").desc(), F.col("popularity_score").desc(),
                                                   F.col("query_clean").asc())
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("prefix_clean", "query_clean", "fuzzy_score", "rank"))


PAIR_EDITS = 6  # up to so many edits two whole pieces together are a key, beyond it one


def _window_lists(popular: DataFrame, lengths: list[int], limit: int, windows) -> DataFrame:
    """``(m, win, query_clean, rank)``: for prefixes of length ``m``, every window with its best
    ``limit`` queries in list order.  ``windows`` gives the array of a query's windows.

    A query below rank ``limit`` of a window has ``limit`` queries before it that score no
    less through the same window and stand before it in the list: no list loses it."""
    e = popular.select("query_clean", "popularity_score", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("m"))
    e = e.select("m", "query_clean", "popularity_score", F.explode(F.array_distinct(windows)).alias("win"))
    w = Window.partitionBy("m", "win").orderBy(F.col("popularity_score").desc(), F.col("query_clean").asc())
    return cut(e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
               .select("m", "win", "query_clean", "rank"))


def _piece_pairs(n: str, d: str) -> str:
    """SQL: the pieces that make a key, as structs (i, j), of a window of ``n`` letters that is
    at most ``d`` edits from a prefix.  Of ``d + 2`` pieces two stay whole, of ``d + 1`` one
    does (i = j); a window with fewer letters than that promises nothing (i = -1)."""
    t = f"least({d} + if({d} <= {PAIR_EDITS}, 2, 1), {n})"
    return (f"CASE WHEN {t} - {d} >= 2 THEN flatten(transform(sequence(0, {t} - 2), i -> transform("
            f"sequence(i + 1, {t} - 1), j -> struct(i, j, {t} AS t)))) "
            f"WHEN {t} - {d} = 1 THEN transform(sequence(0, {t} - 1), i -> struct(i, i AS j, {t} AS t)) "
            f"ELSE array(struct(-1 AS i, -1 AS j, 1 AS t)) END")


def _piece(text: str, i: str, shift: str) -> str:
    at = f"CAST(floor({i} * n / t) AS INT)"
    return f"substring({text}, {at} + 1 + {shift}, CAST(floor(({i} + 1) * n / t) AS INT) - {at})"


def _key(text: str, di: str, dj: str) -> F.Column:
    return F.expr(f"CASE WHEN i < 0 THEN '' WHEN i = j THEN {_piece(text, 'i', di)} "
                  f"ELSE concat({_piece(text, 'i', di)}, '\\0', {_piece(text, 'j', dj)}) END")


def _blocked(prefixes: DataFrame, wins: DataFrame, short: list[int]) -> DataFrame:
    """Distinct ``(prefix_clean, win, d)`` that may be at most ``d`` edits apart.

    ``prefixes``: prefix_clean, m, d; ``wins``: m, win; ``short``: lengths below the prefix's
    that windows have.  A whole piece stands in the prefix at most as far off as the edits
    before, between and after the pieces pay for: ``|di| + |dj - di| + |m - n - dj| <= d``.
    """
    edits = prefixes.select("m", "d").distinct()
    w = (wins.join(edits, "m").withColumn("n", F.length("win")).where("m - n <= d")
         .select("m", "win", "n", F.inline(F.expr(_piece_pairs("n", "d"))))
         .select("m", "n", "i", "j", "win", _key("win", "0", "0").alias("key")))
    lengths = F.array(*[F.lit(x) for x in short]) if short else F.array().cast("array<int>")
    p = (prefixes.withColumn("n", F.explode(F.concat(F.array("m"), F.filter(
            lengths, lambda x: (x < F.col("m")) & (x >= F.col("m") - F.col("d"))))))
         .select("prefix_clean", "m", "d", "n", F.inline(F.expr(_piece_pairs("n", "d"))))
         .withColumn("di", F.explode(F.expr("if(i < 0, array(0), sequence(-d, d))")))
         .withColumn("dj", F.explode(F.expr("if(i = j, array(di), sequence(-d, d))")))
         .where("i < 0 OR abs(di) + abs(dj - di) + abs(m - n - dj) <= d")
         .where("i < 0 OR (floor(i * n / t) + di >= 0 AND floor((i + 1) * n / t) + di <= m "
                "AND floor(j * n / t) + dj >= 0 AND floor((j + 1) * n / t) + dj <= m)")
         .select("prefix_clean", "m", "d", "n", "i", "j", _key("prefix_clean", "di", "dj").alias("key")).distinct())
    return p.join(w, ["m", "n", "i", "j", "key"]).select("prefix_clean", "win", "d").distinct()


def fuzzy_window_levenshtein(prefixes: DataFrame, popular: DataFrame,
                             threshold: float = FUZZY_THRESHOLD, limit: int = FUZZY_LIMIT) -> DataFrame:
    """Best ``limit`` queries per prefix by window Levenshtein similarity
    ``100·(1 − min_i levenshtein(p, q[i:i+m]) / m)`` ≥ ``threshold``.

    Fewer edits score higher, so the allowed edits grow (0, 1, all) and only the prefixes
    that have no ``limit`` queries yet go on: equal windows are an equi-join, one edit leaves
    long pieces, and short pieces meet in pairs, at agreeing offsets.  The empty prefix has
    no windows and gets nothing; empty inputs give no rows.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    p = cut(prefixes.select("prefix_clean").distinct().where(F.length("prefix_clean") > 0)
            .withColumn("m", F.length("prefix_clean"))
            .withColumn("_max", F.floor(F.col("m") * (1 - threshold / 100.0) + 1e-9).cast("int")))
    sizes = {r[0]: r[1] for r in p.select("m", "_max").distinct().collect()}  # a row per prefix length
    n = F.length("query_clean")
    windows = F.when(n < F.col("m"), F.array("query_clean")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - F.col("m") + 1, F.lit(1))),
                    lambda i: F.substring(F.col("query_clean"), i, F.col("m"))))
    lists = _window_lists(popular.where(n > 0), sorted(sizes) or [1], limit, windows)
    wins = lists.where("rank = 1").select("m", "win")
    short = sorted(r[0] for r in wins.where(F.length("win") < F.col("m")).select(F.length("win")).distinct().collect())

    def queries_of(pairs: DataFrame) -> DataFrame:
        return cut(pairs.withColumn("m", F.length("prefix_clean")).join(lists, ["m", "win"])
                   .groupBy("prefix_clean", "query_clean").agg(F.min("dist").alias("dist")))

    found = queries_of(p.select("prefix_clean", F.col("prefix_clean").alias("win"), F.lit(0).alias("dist")))
    done, last = 0, max(sizes.values(), default=0)
    while done < last:
        n_found = found.groupBy("prefix_clean").agg(F.count(F.lit(1)).alias("_n"))
        most = 1 if done == 0 else last
        at = cut(p.where(F.col("_max") > done).join(n_found, "prefix_clean", "left")
                 .where(F.coalesce("_n", F.lit(0)) < limit)
                 .select("prefix_clean", "m", F.least(F.lit(most), F.col("_max")).alias("d")))
        # written, so that the test on the distance is not pushed below the distinct, where a
        # pair would be scored once per shared key
        pairs = cut(_blocked(at, wins, short))
        dist = pairs.withColumn("dist", F.levenshtein("prefix_clean", "win", most)) \
            .where((F.col("dist") > done) & (F.col("dist") <= F.col("d")))
        found = (found.unionByName(queries_of(dist.select("prefix_clean", "win", "dist")))
                 .groupBy("prefix_clean", "query_clean").agg(F.min("dist").alias("dist")))
        done = most
    s = found.select("prefix_clean", "query_clean", F.round(
        100.0 * (1.0 - F.col("dist") / F.length("prefix_clean")), 6).alias("fuzzy_score"))
    return _best(s, popular, limit)


# ------------------------------------------------------------ partial ratio

def _codes(strings: list[str], ids: dict[str, int]) -> np.ndarray:
    """Letters as numbers from 1, one row per string; 0 pads and never matches."""
    out = np.zeros((len(strings), max(map(len, strings), default=0)), dtype=np.int64)
    for i, x in enumerate(strings):
        out[i, :len(x)] = [ids.setdefault(c, len(ids) + 1) for c in x]
    return out


class _Lcs:
    """Bit-parallel longest common subsequences of many pairs at once.

    The state of a pair is one bit per letter of its first string, in as many 64-bit words as
    the longest one needs; a step takes the next letter of every second string."""

    def __init__(self, first: list[str], n_ids: int, ids: dict[str, int]):
        self.m = np.array([len(x) for x in first], dtype=np.int64)
        self.words = max(1, -(-int(self.m.max(initial=1)) // 64))
        self.masks = np.zeros((len(first), n_ids + 1, self.words), dtype=np.uint64)
        for i, x in enumerate(first):
            for j, c in enumerate(x):
                if c in ids:
                    self.masks[i, ids[c], j // 64] |= np.uint64(1 << (j % 64))
        bits = np.clip(self.m[:, None] - 64 * np.arange(self.words), 0, 64)
        # a shift by 64 is undefined: full words apart
        self.full = np.where(bits == 64, np.uint64(2 ** 64 - 1),
                             np.left_shift(np.uint64(1), (bits % 64).astype(np.uint64)) - np.uint64(1))

    def start(self) -> np.ndarray:
        return self.full.copy()

    def step(self, v: np.ndarray, letters: np.ndarray) -> np.ndarray:
        u = v & self.masks[np.arange(len(v)), letters]
        out, carry = np.empty_like(v), np.zeros(len(v), dtype=np.uint64)
        for w in range(self.words):
            total = v[:, w] + u[:, w]
            over = total < v[:, w]
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            out[:, w] = (total | (v[:, w] & ~u[:, w])) & self.full[:, w]
        return out

    def length(self, v: np.ndarray) -> np.ndarray:
        return self.m - np.bitwise_count(v).astype(np.int64).sum(axis=1)


def ratio_batch(first: list[str], second: list[str]) -> np.ndarray:
    """Indel similarity ``100·2·LCS/(len a + len b)`` of each pair, 0 where one is empty."""
    ids: dict[str, int] = {}
    text = _codes(second, ids)
    n = np.array([len(x) for x in second], dtype=np.int64)
    lcs = _Lcs(first, len(ids), ids)
    v = lcs.start()
    for at in range(text.shape[1]):
        v = lcs.step(v, text[:, at])  # the padding matches nothing and leaves the state
    return np.where((n > 0) & (lcs.m > 0), 200.0 * lcs.length(v) / np.maximum(lcs.m + n, 1), 0.0)


def partial_ratio_batch(a_list, b_list) -> np.ndarray:
    """Best indel similarity between the shorter string and every window of the longer one of
    the same length, plus the shorter windows at both ends, for a whole batch of pairs.

    For each start o of the longer strings the state advances one letter per step; after j
    steps it is that of the window ``s2[o:o+j]``.  The windows the scorer uses are read off on
    the way: full (j = m), leading (o = 0, j < m) and trailing ones (o + j = n, j < m).
    """
    swap = [len(a or "") > len(b or "") for a, b in zip(a_list, b_list)]
    s1 = [(b if x else a) or "" for a, b, x in zip(a_list, b_list, swap)]
    s2 = [(a if x else b) or "" for a, b, x in zip(a_list, b_list, swap)]
    best = np.zeros(len(s1))
    ids: dict[str, int] = {}
    text = _codes(s2, ids)
    n = np.array([len(x) for x in s2], dtype=np.int64)
    lcs = _Lcs(s1, len(ids), ids)
    m = lcs.m
    for o in range(text.shape[1]):
        v = lcs.start()
        for j in range(1, int(m.max()) + 1):
            step = (j <= m) & (o + j <= n)
            if not step.any():
                break
            v = np.where(step[:, None], lcs.step(v, text[:, min(o + j, text.shape[1]) - 1]), v)
            window = step & ((j == m) | (o == 0) | (o + j == n))
            best = np.where(window, np.maximum(best, 200.0 * lcs.length(v) / np.maximum(m + j, 1)), best)
    return best


def partial_ratio(s1: str, s2: str) -> float:
    """``partial_ratio_batch`` of one pair."""
    return float(partial_ratio_batch([s1], [s2])[0])


def _batched(score, a: pd.Series, b: pd.Series, cells: int = 4_000_000) -> pd.Series:
    """``score`` over runs of pairs sorted by length, so that a long pair does not pad short
    ones and a run's masks stay bounded."""
    a, b = a.fillna("").to_numpy(), b.fillna("").to_numpy()
    size = np.array([max(len(x), len(y), 1) for x, y in zip(a, b)], dtype=np.int64)
    order, out, lo = np.argsort(size, kind="stable"), np.zeros(len(a)), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * int(size[order[hi]]) <= cells // 64:
            hi += 1
        at = order[lo:hi]
        out[at] = score(list(a[at]), list(b[at]))
        lo = hi
    return pd.Series(np.round(out, 6), dtype="float64")


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _batched(ratio_batch, a, b)


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _batched(partial_ratio_batch, a, b)


def _letters(text: str) -> F.Column:
    """The letters of a column as a set: the i-th occurrence of a letter is an element of its
    own, so that the intersection of two sets counts the letters two strings can share."""
    ch = f"split({text}, '')"
    return F.expr(f"transform({ch}, (c, i) -> concat(c, size(filter(slice({ch}, 1, i), x -> x = c))))")


def _least_shared(m: str, j: str, whole: str, score: float) -> str:
    """SQL: the least common subsequence that a prefix of ``m`` letters needs for ``score``:
    with a window of ``j`` letters, or with some window of its own for a ``whole`` shorter query
    (of which at least the common part is a window)."""
    return (f"CAST(ceil(CASE WHEN {whole} THEN {score} * {j} / {200.0 - score} "
            f"ELSE {score} * ({m} + {j}) / 200.0 END - 1e-9) AS INT)")


def _rarest(df: DataFrame, key: list[str], freq: DataFrame, keep: str) -> DataFrame:
    """``key`` and ``elem``: of each row's letters the ``keep`` rarest (ties by letter)."""
    e = df.select(*key, F.expr(keep).alias("_keep"), F.explode("letters").alias("elem")) \
        .join(freq, "elem", "left").na.fill(0, ["f"])
    w = Window.partitionBy(*key).orderBy("f", "elem")
    return e.withColumn("_r", F.row_number().over(w)).where("_r <= _keep").select(*key, "elem")


def _letter_blocked(prefixes: DataFrame, wins: DataFrame, freq: DataFrame, score: float) -> DataFrame:
    """Distinct ``(prefix_clean, m, win, whole)`` that share enough letters for ``score``.

    If two sets of p and w elements share L, then in one global order the first p - L + 1 and
    the first w - L + 1 elements have one in common; the rarest letters come first.  The
    letters that the pair really shares are then counted, before any scorer runs.
    """
    need = _least_shared("m", "j", "whole", score)
    w = wins.withColumn("need", F.expr(need)).where("need <= j AND need <= m")
    kinds = w.select("m", "j", "whole", "need").distinct()
    p = prefixes.join(kinds, "m")
    wk = _rarest(w, ["m", "j", "whole", "win"], freq, "j - need + 1")
    pk = _rarest(p, ["m", "j", "whole", "prefix_clean"], freq, "m - need + 1")
    pairs = pk.join(wk, ["m", "j", "whole", "elem"]).select("prefix_clean", "m", "j", "whole", "win").distinct()
    return (pairs.join(prefixes.select("prefix_clean", F.col("letters").alias("_p")), "prefix_clean")
            .join(wins.select("m", "whole", "win", F.col("letters").alias("_w")), ["m", "whole", "win"])
            .where(F.size(F.array_intersect("_p", "_w")) >= F.expr(need))
            .select("prefix_clean", "m", "win", "whole"))


def fuzzy_partial_ratio(prefixes: DataFrame, popular: DataFrame,
                        threshold: float = FUZZY_THRESHOLD, limit: int = FUZZY_LIMIT) -> DataFrame:
    """Best ``limit`` queries per prefix by partial ratio ≥ ``threshold``.

    A query at least as long as the prefix is scored through its windows; a shorter one is a
    window of its own kind (``whole``), scored against the windows of the prefix.  The least
    score falls in rounds (100, 80, ``threshold``) and prefixes that have ``limit`` queries
    stop.  Empty strings match nothing; repeated prefixes count once; empty inputs give no rows.
    """
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be above 0 and at most 100")
    p = cut(prefixes.select("prefix_clean").distinct().where(F.length("prefix_clean") > 0)
            .withColumn("m", F.length("prefix_clean")).withColumn("letters", _letters("prefix_clean")))
    sizes = sorted(r[0] for r in p.select("m").distinct().collect())  # a row per prefix length
    n, m, q = F.length("query_clean"), F.col("m"), F.col("query_clean")
    # a shorter window at an end scores at most 200 j / (m + j)
    edge = F.ceil(m * (threshold / (200.0 - threshold)) - 1e-9).cast("int")
    ends = F.when(edge < m, F.sequence(edge, m - 1)).otherwise(F.array().cast("array<int>"))
    windows = F.when(n < m, F.array(q)).otherwise(F.concat(
        F.transform(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: F.substring(q, i, m)),
        F.transform(ends, lambda j: F.substring(q, F.lit(1), j)),
        F.transform(ends, lambda j: F.substring(q, n - j + 1, j))))
    # a window of a shorter query is told apart from an equal window of a longer one
    marked = F.transform(windows, lambda x: F.concat(F.when(n < m, F.lit("1")).otherwise(F.lit("0")), x))
    lists = _window_lists(popular.where(n > 0), sizes or [1], limit, marked)
    wins = (lists.where("rank = 1").select("m", F.expr("substring(win, 2)").alias("win"),
                                           F.expr("substring(win, 1, 1) = '1'").alias("whole")))
    wins = cut(wins.withColumn("j", F.length("win")).withColumn("letters", _letters("win")))
    freq = cut(wins.select(F.explode("letters").alias("elem")).groupBy("elem").agg(F.count(F.lit(1)).alias("f")))
    short = F.array(*[F.lit(r[0]) for r in wins.where("whole").select("j").distinct().collect()]) \
        .cast("array<int>")  # lengths below the longest prefix

    def queries_of(pairs: DataFrame) -> DataFrame:
        mark = F.concat(F.when(F.col("whole"), F.lit("1")).otherwise(F.lit("0")), F.col("win"))
        return cut(pairs.select("prefix_clean", "m", mark.alias("win"), "fuzzy_score").join(lists, ["m", "win"])
                   .groupBy("prefix_clean", "query_clean").agg(F.max("fuzzy_score").alias("fuzzy_score")))

    # a score of 100: the prefix is a window, or holds the whole query
    parts = F.array_distinct(F.flatten(F.transform(F.filter(short, lambda j: j < m), lambda j: F.transform(
        F.sequence(F.lit(1), m - j + 1), lambda i: F.substring(F.col("prefix_clean"), i, j)))))
    equal = p.select("prefix_clean", "m", F.col("prefix_clean").alias("win"), F.lit(False).alias("whole")) \
        .unionByName(p.select("prefix_clean", "m", F.explode(parts).alias("win"), F.lit(True).alias("whole")))
    found = queries_of(equal.withColumn("fuzzy_score", F.lit(100.0)))
    for least in [x for x in (80.0, threshold) if threshold <= x < 100]:
        n_found = found.groupBy("prefix_clean").agg(F.count(F.lit(1)).alias("_n"))
        at = cut(p.join(n_found, "prefix_clean", "left").where(F.coalesce("_n", F.lit(0)) < limit).drop("_n"))
        # written, so that the score filter is not pushed into the blocking join
        pairs = cut(_letter_blocked(at, wins, freq, least))
        scored = (pairs.where("NOT whole").withColumn("fuzzy_score", ratio_udf("prefix_clean", "win"))
                  .unionByName(pairs.where("whole").withColumn("fuzzy_score", partial_ratio_udf("prefix_clean", "win"))))
        found = (found.unionByName(queries_of(scored.where(F.col("fuzzy_score") >= least)))
                 .groupBy("prefix_clean", "query_clean").agg(F.max("fuzzy_score").alias("fuzzy_score")))
    return _best(found, popular, limit)
