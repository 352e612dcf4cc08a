"""The set-based cascade equals a straightforward per-prefix loop.

The loop below walks each prefix through the stages one query at a time
(history, exact prefix, back-off levels with the running count, fuzzy,
popular fallback up to 2k, sort, back-fill), with the same documented
tie-breaks; the Spark plan must produce exactly the same ranked lists.
"""

import hashlib

import pytest

from typeahead.functions.text import normalize_text
from typeahead.plans import track_a as TA
from typeahead.sources import fixtures as fx

from test_fuzzy_windows import slow_partial_ratio



def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _window_score(p, q):
    m = len(p)
    wins = [q[i:i + m] for i in range(max(len(q) - m + 1, 1))]
    return round(100.0 * (1 - min(_lev(p, w) for w in wins) / m), 6)


@pytest.mark.parametrize("K, fuzzy", [(20, "levenshtein"), (150, "levenshtein"), (20, "partial_ratio")])
def test_cascade_matches_sequential_loop(spark, sf, K, fuzzy):
    similarity = _window_score if fuzzy == "levenshtein" else lambda p, q: round(slow_partial_ratio(p, q), 6)
    ins = fx.inputs(spark, sf)
    a = TA.build(ins["train"], ins["pool"], ins["features"], ins["test"], K)
    prefixes = ins["test"].select(normalize_text("prefix").alias("prefix_clean")).distinct()
    got = {}
    for r in TA.cascade_ranked(a, prefixes, K, fuzzy).collect():
        got.setdefault(r.prefix_clean, []).append((r.rank, r.query_clean))
    got = {p: [q for _, q in sorted(v)] for p, v in got.items()}

    hist = {}
    for r in a.history.collect():
        hist.setdefault(r.prefix_clean, []).append((r.query_clean, r.freq))
    pop = {r.query_clean: r.popularity_norm for r in a.popularity.collect()}
    by_pop = sorted(pop, key=lambda q: (-pop[q], q))

    def post(key):
        return [q for q in by_pop if key and q.startswith(key)]

    rows = sorted(a.scored.collect(), key=lambda r: (-r.popularity_score, r.query_clean, r.query))
    popular = {}
    for r in rows:
        popular.setdefault(r.query_clean, r.popularity_score)
    fill_order = sorted({r.query_clean for r in rows},
                        key=lambda q: (hashlib.md5(f"42|{q}".encode()).hexdigest(), q))[:2 * K]

    for p in [r.prefix_clean for r in prefixes.collect()]:
        c = {}
        for q, f in hist.get(p, []):
            c[q] = c.get(q, 0) + 100.0 * f
        for q in post(p):
            c[q] = c.get(q, 0) + 50.0 + pop[q] * 20.0
        if len(c) < K and len(p) >= 2:
            for i in range(len(p), 1, -1):
                for q in post(p[:i]):
                    if q not in c:
                        c[q] = 25.0 * i / len(p) + pop[q] * 10.0
                if len(c) >= K:
                    break
        if len(c) < K and p:
            fz = [(q, similarity(p, q)) for q in popular]
            fz = sorted([x for x in fz if x[1] >= 60], key=lambda x: (-x[1], -popular[x[0]], x[0]))[:K]
            for q, sc in fz:
                if q not in c:
                    c[q] = sc / 100.0 * 30.0 + pop.get(q, 0.0) * 10.0
        if len(c) < K:
            for r in rows[:2 * K]:
                if r.query_clean not in c:
                    c[r.query_clean] = r.popularity_norm * 5.0
                if len(c) >= 2 * K:
                    break
        ranked = [q for q, _ in sorted(c.items(), key=lambda x: (-round(x[1], 6), x[0]))[:K]]
        for q in fill_order:
            if len(ranked) >= K:
                break
            if q not in ranked:
                ranked.append(q)
        assert got.get(p, []) == ranked, p
