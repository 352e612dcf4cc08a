"""Retrieval operators: BM25 by brute force, top-k properties, fuzzy blocking."""

import math
from collections import Counter


from typeahead.operators import fuzzy as FZ
from typeahead.operators import lexical as L


def _py_grams(t, n=3):
    t = (t or "").lower().strip()
    if not t:
        return []
    return [t] if len(t) < n else [t[i:i + n] for i in range(len(t) - n + 1)]


def _py_bm25(pool, prefix, k1=1.5, b=0.75, eps=0.25):
    docs = [_py_grams(q) for q in pool]
    N = len(docs)
    avgdl = sum(len(d) for d in docs) / N
    df = Counter(g for d in docs for g in set(d))
    idf = {g: math.log(N - c + 0.5) - math.log(c + 0.5) for g, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {g: (eps * mean if v < 0 else v) for g, v in idf.items()}
    out = {}
    for q, d in zip(pool, docs):
        tf = Counter(d)
        s = sum(idf.get(g, 0) * tf[g] * (k1 + 1) / (tf[g] + k1 * (1 - b + b * len(d) / avgdl))
                for g in _py_grams(prefix))
        if any(g in tf for g in _py_grams(prefix)):
            out[q] = round(s, 6)
    return out


POOL = ["red dress", "dress for women", "shoes", "sheos men", "women kurti", "saree silk", "t shirt",
        "iphone 13", "laptop bag", "lap desk", "dres"]


def test_bm25_matches_brute_force(spark):
    pool = spark.createDataFrame([(q,) for q in POOL], "query string")
    probes = ["dress", "dres", "sheos", "womn", "tshrt", "kurti", "saree"]
    idx = L.bm25_index(pool)
    got = L.bm25_scores(idx, spark.createDataFrame([(p,) for p in probes], "prefix string"))
    rows = {(r.prefix, r.candidate): r.bm25_score for r in got.collect()}
    for p in probes:
        want = _py_bm25(POOL, p)
        have = {c: s for (pp, c), s in rows.items() if pp == p}
        assert set(have) == set(want)
        for c in want:
            assert abs(have[c] - want[c]) < 1e-6


def test_topk_properties(spark):
    pool = spark.createDataFrame([(q,) for q in POOL], "query string")
    idx = L.bm25_index(pool)
    top = L.bm25_topk(idx, spark.createDataFrame([("dress",), ("lap",)], "prefix string"), 3).collect()
    by = {}
    for r in top:
        by.setdefault(r.prefix, []).append((r.rank, r.bm25_score, r.candidate))
    for lst in by.values():
        lst.sort()
        assert len(lst) <= 3
        assert len({c for _, _, c in lst}) == len(lst)
        scores = [s for _, s, _ in lst]
        assert scores == sorted(scores, reverse=True)


def test_fuzzy_blocking_is_exact(spark):
    """The blocked R5 equals a brute-force scan over all pairs."""
    queries = ["iphone", "iphone case", "ipad", "laptop", "lap desk", "shoes", "sheos", "red dress",
               "dress red", "women dress", "phone", "fone cover"]
    pref = ["ifon", "lapt", "sho", "red dr", "womn"]
    popular = spark.createDataFrame([(q, 1.0) for q in queries], "query_clean string, popularity_score double")
    prefixes = spark.createDataFrame([(p,) for p in pref], "prefix_clean string")
    got = {(r.prefix_clean, r.query_clean): r.fuzzy_score
           for r in FZ.fuzzy_window_levenshtein(prefixes, popular, 60.0, 50).collect()}

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]

    want = {}
    for p in pref:
        m = len(p)
        for q in queries:
            wins = [q[i:i + m] for i in range(max(len(q) - m + 1, 1))]
            s = round(100.0 * (1 - min(lev(p, w) for w in wins) / m), 6)
            if s >= 60:
                want[(p, q)] = s
    assert got == want


def test_partial_ratio_examples():
    # hand-worked: best window is the end window "one", LCS("ifon", "one") = 2
    assert abs(FZ.partial_ratio("ifon", "iphone") - 200.0 * 2 / 7) < 1e-9
    assert FZ.partial_ratio("abc", "xxabcxx") == 100.0
    assert FZ.partial_ratio("", "abc") == 0.0


def test_sample_negatives_bounds(spark):
    from typeahead.operators.features import sample_negatives
    cands = spark.createDataFrame([("p", f"c{i}") for i in range(30)] + [("q", "x"), ("q", "y")],
                                  "prefix string, candidate string")
    pairs = spark.createDataFrame([("p", "c3"), ("p", "zz"), ("q", "x"), ("r", "x")], "prefix string, query string")
    got = sample_negatives(pairs, cands).collect()
    by = {}
    for r in got:
        by.setdefault((r.prefix, r.query), []).append(r.candidate)
    for (p, q), negs in by.items():
        assert q not in negs and len(set(negs)) == len(negs)
    assert 5 <= len(by[("p", "c3")]) <= 10 and 5 <= len(by[("p", "zz")]) <= 10
    assert by[("q", "x")] == ["y"]
    assert ("r", "x") not in by


def test_bm25_pruned_topk_equals_exhaustive(spark, sf):
    """The MaxScore-pruned top-k equals full scoring on the fixture tables."""
    from typeahead.sources import fixtures as fx
    idx = L.bm25_index(fx.fx_pool(spark, sf))
    test = fx.fx_test(spark, sf)
    cols = ["prefix", "candidate", "bm25_score", "rank"]
    for k in (5, 40):
        a = {tuple(r) for r in L.bm25_topk(idx, test, k, prune=True).select(*cols).collect()}
        b = {tuple(r) for r in L.bm25_topk(idx, test, k, prune=False).select(*cols).collect()}
        assert a == b


def test_bm25_topk_meets_every_shard(spark, monkeypatch):
    """Several shards and dealt prefixes give the exhaustive lists, ties by text; the grams of
    a text are cut once, not once more for each gram in a pushed filter."""
    monkeypatch.setattr(L, "SHARD_QUERIES", 4)
    monkeypatch.setattr(L, "FEW_PREFIXES", 2)
    pool = spark.createDataFrame([(q,) for q in [*POOL, "dress a", "dress b", "dress c", ""]], "query string")
    asked = spark.createDataFrame([("dress",), ("lap",), ("sho",), (None,), ("",), ("zzz",), ("dress",), ("women",)],
                                  "prefix string")
    plan = L.bm25_postings(pool)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    idx = L.bm25_index(pool)
    rows = [{tuple(r) for r in L.bm25_topk(idx, asked, 3, prune=p).select("prefix", "candidate", "bm25_score", "rank")
             .collect()} for p in (True, False)]
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == {"dress", "lap", "sho", "women"}
