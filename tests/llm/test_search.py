"""Ranked search against scoring every document in a plain loop."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from typeahead.llm import strata_search

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().lower())


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + (25 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        found += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(found, key=str)


WORDS = "the quick brown fox jumps over lazy dog and runs far away from home élan 42nd".split()
DOCS = [(i, " ".join(WORDS[(i * j * j + j) % len(WORDS)] for j in range(1 + i % 37))) for i in range(150)]
DOCS += [(i, "same text of some copies: fox") for i in range(150, 190)]
DOCS += [(200, None), (201, ""), (202, "?!"), (203, "FOX\nfox_Fox " * 3000), (None, "fox home"), (204, "日本 fox"), (5, DOCS[5][1])]
ITEMS = [(1, "The fox, the fox and the lazy dog"), (2, None), (3, ""), (4, "unknown words only"), (5, "élan 42nd 日本"),
         (6, "same copies fox")]


@pytest.mark.parametrize("shard_terms", [40, 10_000_000])
def test_search(spark, shard_terms):
    docs = spark.createDataFrame([d + (1, 2, "x") for d in DOCS], "doc_id long, text string, m int, shard int, term string").repartition(3)
    items = spark.createDataFrame([i + (1,) for i in ITEMS], "item_id long, text string, block int")
    index = strata_search.build_index(docs, shard_terms=shard_terms)
    for k in (3, 20):
        got = strata_search.search(index, items, k).collect()
        assert sorted(((int(r.item_id), r.rank, r.id, r.score) for r in got), key=str) == brute(DOCS, ITEMS, k)


def test_search_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(strata_search, "ITEM_BLOCK", 2)
    monkeypatch.setattr(strata_search, "BATCH_TERMS", 10)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")  # a repeated item is one item
    got = strata_search.search(strata_search.build_index(docs, shard_terms=100), items, 7).collect()
    assert sorted(((int(r.item_id), r.rank, r.id, r.score) for r in got), key=str) == brute(DOCS, ITEMS, 7)


def test_search_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for d in (docs, docs.limit(0)):
        assert strata_search.search(strata_search.build_index(d), items).count() == 0
    some = strata_search.build_index(docs.withColumn("text", F.lit("fox")))
    assert strata_search.search(some, items.limit(0)).count() == 0
