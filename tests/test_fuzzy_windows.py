"""R4 and R5 against scoring every prefix with every query in a plain loop."""

import random
from functools import lru_cache

import pytest
from typeahead.operators import fuzzy as FZ


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def slow_partial_ratio(a, b):
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    windows = [b[i:i + m] for i in range(n - m + 1)] + [b[:i] for i in range(1, m)] + [b[n - i:] for i in range(1, m)]
    return max(200.0 * lcs(a, w) / (m + len(w)) for w in windows)


@lru_cache(None)
def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def window_score(p, q):
    m = len(p)
    return 100.0 * (1 - min(lev(p, q[i:i + m]) for i in range(max(len(q) - m + 1, 1))) / m) if p else 0.0


def brute(prefixes, popular, score, limit, threshold=60):
    out = set()
    for p in set(prefixes):
        hits = [(-round(score(p, q), 6), -pop, q) for q, pop in popular if q]
        hits = sorted(h for h in hits if -h[0] >= threshold) if p else []
        out |= {(p, q, -s, r) for r, (s, _, q) in enumerate(hits[:limit], 1)}
    return out


def texts(seed, n, low, high, letters="aabcde e"):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(n)})


QUERIES = texts(1, 250, 1, 16) + ["iphone", "iphone case", "é日本 é", "x" * 80, "ab" * 70]
POPULAR = [(q, float(len(q) % 3)) for q in QUERIES]
PREFIXES = texts(2, 40, 1, 13) + ["", "ifon", "iphne", "é日 é", "x" * 70, "ab" * 34 + "c", "abcabcabcabcabcabcabc"]


def frames(spark):
    # repeated prefixes count once; other columns are ignored
    p = spark.createDataFrame([(x, 1) for x in PREFIXES + PREFIXES[:5]], "prefix_clean string, d int")
    return p, spark.createDataFrame([(q, s, 2) for q, s in POPULAR], "query_clean string, popularity_score double, m int")


@pytest.mark.parametrize("limit, threshold", [(4, 60), (30, 85), (150, 30)])
def test_window_levenshtein_is_exact(spark, limit, threshold):
    p, q = frames(spark)
    got = FZ.fuzzy_window_levenshtein(p, q, float(threshold), limit).collect()
    assert {(r.prefix_clean, r.query_clean, r.fuzzy_score, r["rank"]) for r in got} == \
        brute(PREFIXES, POPULAR, window_score, limit, threshold)


@pytest.mark.parametrize("limit, threshold", [(4, 60), (150, 60)])
def test_partial_ratio_lists_are_exact(spark, limit, threshold):
    p, q = frames(spark)
    got = FZ.fuzzy_partial_ratio(p, q, float(threshold), limit).collect()
    assert {(r.prefix_clean, r.query_clean, r.fuzzy_score, r["rank"]) for r in got} == \
        brute(PREFIXES, POPULAR, slow_partial_ratio, limit, threshold)


def test_empty_inputs(spark):
    p, q = frames(spark)
    for match in (FZ.fuzzy_window_levenshtein, FZ.fuzzy_partial_ratio):
        assert match(p.limit(0), q).count() == 0
        assert match(p, q.limit(0)).count() == 0
        assert match(p.where("prefix_clean = ''"), q).count() == 0


def test_batch_scorer_on_strings_of_several_words():
    r = random.Random(5)
    pairs = [("".join(r.choice("abc ") for _ in range(r.choice([0, 3, 20, 63, 64, 65, 130]))),
              "".join(r.choice("abcd ") for _ in range(r.choice([0, 5, 64, 90, 140])))) for _ in range(60)]
    got = FZ.partial_ratio_batch(*zip(*pairs))
    assert all(abs(g - slow_partial_ratio(a, b)) < 1e-9 for g, (a, b) in zip(got, pairs))
    got = FZ.ratio_batch(*map(list, zip(*pairs)))
    assert all(abs(g - (200 * lcs(a, b) / (len(a) + len(b)) if a and b else 0)) < 1e-9 for g, (a, b) in zip(got, pairs))


def test_prefixes_meet_windows_not_queries(spark, monkeypatch):
    """On the fixture tables fewer than a fifth of all (prefix, query) pairs are built."""
    from typeahead.plans import track_a as TA
    from typeahead.plans.q_prefix import _tp
    from typeahead.sources import fixtures as fx
    i = fx.inputs(spark, "/root/testdata/sf0.01")
    a = TA.build(i["train"], i["pool"], i["features"], i["test"])
    built = []
    monkeypatch.setattr(FZ, "cut", lambda df, kept=FZ.cut: (
        built.append(n.count()) if "win" in (n := kept(df)).columns and "prefix_clean" in n.columns else None, n)[1])
    p = _tp(i["test"])
    pairs = p.count() * a.popular.count()
    for match in (FZ.fuzzy_window_levenshtein, FZ.fuzzy_partial_ratio):
        built.clear()
        match(p, a.popular).count()
        assert built and sum(built) < 0.2 * pairs, (match.__name__, built, pairs)
